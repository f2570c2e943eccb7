"""Functions of the name-screening engine."""
