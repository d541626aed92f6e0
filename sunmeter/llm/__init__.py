"""Operators for preparing training text, each DataFrame in, DataFrame out."""
