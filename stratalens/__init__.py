"""Spark-native analytics over equity research tables."""
