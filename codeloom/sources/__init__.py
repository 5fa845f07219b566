"""Readers of index files."""
