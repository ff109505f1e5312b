"""Readers, writers and the logical tables over the driver's data."""
