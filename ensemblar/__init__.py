"""Ensemble-forecast verification on PySpark."""
