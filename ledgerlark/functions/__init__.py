"""Column expressions: figures, text, fiscal years."""
