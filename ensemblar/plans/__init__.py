"""Registered queries: operators applied to forecast-shaped views of the given tables."""
