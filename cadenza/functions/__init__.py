"""Plan-time helpers and column expressions."""
