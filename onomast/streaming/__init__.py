"""Streaming of the name-screening engine."""
