"""Sources of the name-screening engine."""
