"""Spark-native full-text retrieval and text-processing engine."""
