"""Spark-native forecasting and market-analytics engine."""
