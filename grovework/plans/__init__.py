"""Registered queries: operators applied to views over the given tables."""
