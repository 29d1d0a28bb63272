"""Spark-native knowledge-memory analytics."""
