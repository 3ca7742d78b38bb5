"""Operators for preparing training data. Nothing else in netlens imports this package."""
