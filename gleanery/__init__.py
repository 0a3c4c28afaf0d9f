"""Spark-native text analytics."""
