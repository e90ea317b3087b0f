"""Relational operators of the fact engine."""
