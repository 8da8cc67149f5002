"""Operators for large training-data pipelines (problems 1 to 9)."""
