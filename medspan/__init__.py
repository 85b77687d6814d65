"""Spark-native clinical document analytics."""
