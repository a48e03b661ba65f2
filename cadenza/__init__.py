"""Panel forecasting benchmarks as lazy Spark plans."""

__version__ = "0.1.0"
