"""Spark-native anonymisation and rule mining."""
