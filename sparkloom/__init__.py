"""Spark-native curation and evaluation analytics."""
