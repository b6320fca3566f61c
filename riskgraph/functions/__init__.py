"""Column functions and session helpers shared by all operators."""
