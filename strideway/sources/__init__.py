"""Readers, writers, and the adapter that derives a street network from the driver's tables."""
