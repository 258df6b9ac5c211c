"""Operators over whole corpora: DataFrames in, DataFrames out."""
