"""Column expressions: values, keys, order."""
