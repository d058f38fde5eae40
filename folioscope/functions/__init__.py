"""Column expressions of the block operators."""
