"""Registered queries on the given tables, each with the SQL that gives the same rows."""
