"""Readers, logical tables and stored results."""
