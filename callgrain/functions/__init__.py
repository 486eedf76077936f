"""Column builders and vectorised text functions."""
