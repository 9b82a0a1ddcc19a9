"""Risk, cost and drift analytics for registries of model tool servers, on Spark."""

__version__ = "0.1.0"
