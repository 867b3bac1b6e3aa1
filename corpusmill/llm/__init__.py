"""Operators for preparing training data at large scale."""
