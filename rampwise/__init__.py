"""Ramp and transient analytics on Spark."""
