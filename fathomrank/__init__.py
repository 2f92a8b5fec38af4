"""Hybrid retrieval and ranking expressed as Spark DataFrame plans."""
