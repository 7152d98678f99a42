"""Operators for training-data pipelines: text, pages and archives as Spark jobs."""
