"""Column functions with the dialect's semantics, and the function reference."""
