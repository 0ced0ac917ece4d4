"""Column functions: keys and text, numbers, arrays and geometry."""
