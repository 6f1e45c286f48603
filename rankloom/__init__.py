"""Organic-search analytics as PySpark DataFrame and Structured Streaming jobs."""
