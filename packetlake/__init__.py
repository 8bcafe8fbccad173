"""Captured-traffic analytics on Spark."""
