"""PySpark-native engine for scoring gridded temperature corrections against station truth."""

__version__ = "0.2.0"
