"""Column helpers and aggregate measures."""
