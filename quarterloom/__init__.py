"""Spark-native analytics over quarterly holdings: relational operators, graph operators and record-level data processing."""

__version__ = "0.1.0"
