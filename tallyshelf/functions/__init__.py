"""Column expressions and aggregate building blocks."""
