"""Column functions: no actions, no Python per row."""
