"""Readers and writers of model corpora."""
