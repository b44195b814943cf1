"""Retrieval-benchmark analytics expressed as Spark DataFrame plans."""
