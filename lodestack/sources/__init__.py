"""Readers and writers of catalogue data."""
