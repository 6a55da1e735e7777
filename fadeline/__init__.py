"""Spark-native analytics of per-device degradation sequences."""
