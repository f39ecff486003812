"""Column functions and fixed lists."""
