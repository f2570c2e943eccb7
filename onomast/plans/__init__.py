"""Plans of the name-screening engine."""
