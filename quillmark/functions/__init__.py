"""Column expressions: text, vectors, grades."""
