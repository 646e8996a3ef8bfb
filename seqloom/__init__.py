"""Sequence, hit-table and embedding analytics on Spark."""
