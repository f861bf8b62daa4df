"""Spark-native analytics over OHLCV bars: indicators, labels, models, signals and backtests."""

__version__ = "0.1.0"
