"""Spark-native grid indexes for high-dimensional range queries."""
