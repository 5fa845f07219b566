"""Registered queries, the index they run on, and SQL to compare them with."""
