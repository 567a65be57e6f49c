"""Spark-native analytics for rates time series and event data."""
