"""Queries over the given tables, their SQL restatements, and the comparison of both."""
