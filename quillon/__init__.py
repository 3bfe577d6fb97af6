"""Spark-native data preparation and evaluation analytics."""
