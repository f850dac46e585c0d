"""Spark-native analytics over music credits and listening histories."""

__version__ = "0.1.0"
