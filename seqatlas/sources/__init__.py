"""Readers, layouts and writers of the stage tables."""
