"""Operators for training-data pipelines, each by its own method. Nothing else in the library imports them."""
