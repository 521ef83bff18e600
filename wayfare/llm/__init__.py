"""Operators for large training corpora: one module per operator, queries and SQL twins in ``catalog``."""
