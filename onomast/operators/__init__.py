"""Operators of the name-screening engine."""
