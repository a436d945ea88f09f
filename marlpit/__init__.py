"""Spark-native document retrieval, scoring and training-data operators."""
