"""Spark-native annotation, similarity and evaluation analytics."""
