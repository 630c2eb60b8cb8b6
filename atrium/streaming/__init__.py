"""Plans as they arrive."""
