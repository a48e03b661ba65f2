"""DataFrame operators: panel preparation, features, backtests, models, metrics."""
