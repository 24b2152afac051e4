"""Spark-native document and reading analytics."""
