"""Column functions: text, times and displayed numbers."""
