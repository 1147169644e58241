"""Incremental delivery of results."""
