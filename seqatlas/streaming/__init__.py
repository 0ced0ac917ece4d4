"""Incremental processing of newly arrived inputs."""
