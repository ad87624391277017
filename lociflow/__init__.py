"""Spark-native analytics for chromosome contact pairs."""

__version__ = "0.1.0"
