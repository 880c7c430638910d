"""Tidemark: a PySpark-native engine for device / measurement time series."""

__version__ = "0.1.0"
