"""Queries over the provided tables, and the SQL that states their results."""
