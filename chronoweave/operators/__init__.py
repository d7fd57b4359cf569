"""Relational operators: candidates, scoring engines, fusion, ranking and metrics, significance, generators."""
