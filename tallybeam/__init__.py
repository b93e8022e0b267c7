"""Telemetry analytics for command-line AI assistants, written as PySpark DataFrame jobs."""
