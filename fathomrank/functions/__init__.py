"""Column functions: tokens, vectors, ordered sums."""
