"""Operators for preparing text and records as training data. Nothing outside this package imports it."""
