"""Ranked retrieval over source code and text, expressed as Spark DataFrame jobs."""

__version__ = "0.1.0"
