"""Column-expression rules, probability models and special functions."""
