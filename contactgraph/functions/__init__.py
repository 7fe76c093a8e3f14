"""Column functions and row-order helpers used by the operators."""
