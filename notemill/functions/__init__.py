"""Column expressions: text, arrays, run names."""
