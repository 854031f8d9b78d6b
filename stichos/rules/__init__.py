"""Dialect rules as tables of SQL predicates (D-*)."""
