"""Operators of a training-data pipeline: one module each, with the query that applies it to its whole table."""
