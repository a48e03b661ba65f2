"""Structured Streaming counterparts of the roll-ups."""
