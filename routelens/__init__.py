"""Spark-native analytics for cost-aware verifier routing."""
