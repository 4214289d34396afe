"""Telemetry analytics for wearable and site sensors on PySpark."""
