"""Column functions: converters, keys, text."""
