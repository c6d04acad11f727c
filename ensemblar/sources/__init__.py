"""Scans into the canonical schema, and sinks."""
