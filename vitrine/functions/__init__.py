"""Column expressions: text matching, paths and media metadata."""
