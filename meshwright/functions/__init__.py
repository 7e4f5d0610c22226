"""Column expressions: geometry, hexagonal grid, radio physics."""
