"""Column functions: grounding, Gaussian similarity, text. All are native expressions."""
