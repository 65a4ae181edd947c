"""The stateless operators and the coverage table over arriving files."""
