"""Spark-native quality ranking of recorded episodes."""
