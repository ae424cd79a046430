"""larkspur: a PySpark-native analytics engine for code-workspace and corpus data."""

__version__ = "0.1.0"
