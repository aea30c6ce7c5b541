"""Spark-native analytics over source trees held as tables."""
