"""Whole analysis jobs: stage tables in, stage tables out."""
