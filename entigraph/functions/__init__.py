"""Column-level functions: geometry, vectors, text analysis, masks."""
