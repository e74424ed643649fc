"""tidemark: a PySpark-native engine for self-describing event data."""

__version__ = "0.1.0"
