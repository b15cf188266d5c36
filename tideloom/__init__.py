"""Spark-native online learning and data-processing engine."""
