"""PySpark-native engine for versioned statutory text and corpus data processing."""

__version__ = "0.1.0"
