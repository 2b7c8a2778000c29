"""Composite runs and the mapping onto the star-schema tables."""
