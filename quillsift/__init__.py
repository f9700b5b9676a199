"""Spark-native private text analytics and retrieval."""
