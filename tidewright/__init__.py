"""Time-series features, backtests and corpus operators on Spark."""
