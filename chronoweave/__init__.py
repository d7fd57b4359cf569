"""Time-aware text retrieval analytics, written as Spark DataFrame plans."""
