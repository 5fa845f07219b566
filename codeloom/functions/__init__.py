"""Scalar functions over symbol strings and paths, as Column expressions."""
