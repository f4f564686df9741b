"""Column helpers: pure expressions on vectors, numbers and names."""
