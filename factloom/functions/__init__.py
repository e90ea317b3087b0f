"""Column expressions: time, values, confidence, names."""
