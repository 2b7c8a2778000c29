"""Column functions and distributed order statistics."""
