"""Spark jobs over corpora of textual concept models and class models."""
