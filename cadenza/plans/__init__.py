"""Specs, tasks, window arithmetic, configuration and the runner."""
