"""Operators for training-data pipelines, their queries and SQL. Nothing else in the library imports this package."""
