"""Whole queries over the given tables, and their registry."""
