"""Composite plans, Spark ML models and the registered queries with their SQL twins."""
