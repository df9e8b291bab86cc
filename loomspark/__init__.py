"""Spark-native corpus analytics, hybrid retrieval and training-data operators."""
