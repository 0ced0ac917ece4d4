"""Profiling and comparison of labelled sequence corpora, as Spark DataFrame jobs."""
