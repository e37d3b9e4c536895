"""Registered queries: the operators over views of the given tables, with their SQL."""
