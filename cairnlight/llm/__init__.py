"""Operators that prepare text and numbers for training data."""
