"""Queries over the given tables, one or more per operator, each with the SQL that must agree."""
