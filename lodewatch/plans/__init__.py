"""Queries over the standard tables, with their SQL."""
