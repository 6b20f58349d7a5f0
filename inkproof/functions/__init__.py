"""Column functions: they build expressions and touch no data."""
