"""Spark-native engine for evolving the shape of stored data."""
