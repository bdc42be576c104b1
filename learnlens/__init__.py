"""Spark-native analytics over the event telemetry of an online learning platform."""

__version__ = "0.1.0"
