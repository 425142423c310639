"""Batch matching and retrieval of large record collections on Spark."""
