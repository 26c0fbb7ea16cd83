"""Spark-native analytics for machine-learning sample tables."""
