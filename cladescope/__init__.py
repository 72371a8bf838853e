"""Comparative-genomics analytics expressed as Spark DataFrame pipelines."""

__version__ = "0.1.0"
