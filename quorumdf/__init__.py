"""Spark-native engine for building, checking and serving text-decision models."""

__version__ = "0.1.0"
