"""The same flows over arriving data."""
