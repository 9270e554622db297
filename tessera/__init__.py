"""Spark-native document knowledge-graph analytics."""
