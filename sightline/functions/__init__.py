"""Pure Column expressions: labels, geometry, pixels, hashing."""
