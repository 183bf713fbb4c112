"""Readers, writers, catalog views and payload parsers."""
