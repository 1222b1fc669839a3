"""Queries over the given tables, registered by name."""
