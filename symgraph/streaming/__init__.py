"""Incremental and streaming refresh."""
