"""A PySpark-native engine for group-wise discovery with controlled error rates."""

__version__ = "0.1.0"
