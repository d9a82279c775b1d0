"""Column expressions and constant matrices."""
