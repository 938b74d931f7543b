"""Predicates, scopes and the named queries."""
