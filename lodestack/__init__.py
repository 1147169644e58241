"""Spark-native analytics over catalogues of offline drives."""

__version__ = "0.1.0"
