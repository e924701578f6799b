"""Skein: a PySpark-native engine for document retrieval, change feeds and the tables around them."""

__version__ = "0.1.0"
