"""Readers of evaluation datasets and the persistent store."""
