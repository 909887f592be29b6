"""Spark-native analytics over regulatory financial facts."""
