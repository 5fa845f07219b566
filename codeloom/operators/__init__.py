"""Operators over a code-graph index; each returns a lazy DataFrame."""
