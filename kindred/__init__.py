"""Spark-native similarity, clone detection and corpus preparation."""

__version__ = "0.1.0"
