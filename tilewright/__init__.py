"""tilewright: a PySpark-native engine for slide, patch and feature analytics."""

__version__ = "0.1.0"
