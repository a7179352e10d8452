"""Queries over given tables, with the SQL that gives the same."""
