"""Operators of a training-data pipeline, numbered as dealt."""
