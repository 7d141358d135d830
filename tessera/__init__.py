"""Tessera: a PySpark-native engine for associative-memory analytics."""

__version__ = "0.1.0"
