"""Spark-native analytics for irregular participant time series and their gaps."""

__version__ = "0.1.0"
