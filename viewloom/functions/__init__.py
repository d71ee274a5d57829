"""Column functions: text, vectors, reproducible random numbers."""
