"""Spark-native document-intelligence operators and training-data operators."""
