"""Structured Streaming forms of additive scores."""
