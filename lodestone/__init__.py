"""Spark-native retrieval and data processing over linked document collections."""

__version__ = "0.1.0"
