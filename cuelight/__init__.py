"""Spark-native dialogue search and corpus analytics."""
