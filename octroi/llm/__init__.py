"""Operators for large training-text pipelines. Nothing else in the library imports this package."""
