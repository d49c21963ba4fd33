"""Spark-native vector-fusion analytics."""
