"""Column functions: plain built-in expressions, usable on batch and streaming tables."""
