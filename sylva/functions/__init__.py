"""Column expressions: the canonical edge order and the geometry of rectangles and intervals."""
