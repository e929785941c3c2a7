"""Operators of a training-data pipeline: text, pages, vectors and conversations."""
