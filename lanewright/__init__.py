"""Spark-native analytics for directed road networks and detector time series."""
