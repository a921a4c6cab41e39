"""Spark-native engine for source-knowledge pipelines, audit analytics and training data."""
