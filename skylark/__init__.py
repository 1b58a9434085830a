"""Spark-native analytics over text, web pages, search results and keyword series."""

__version__ = "0.1.0"
