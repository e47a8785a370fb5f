"""Scalar functions as Column expressions, and the glob language."""
