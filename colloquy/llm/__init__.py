"""Operators for training-data pipelines, and the queries registered for them."""
