"""Column functions: vectors, labels, feature preparation."""
