"""Column functions: deterministic randomness, vectors, dense ranks."""
