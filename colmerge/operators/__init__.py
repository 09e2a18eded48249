"""Operators over change logs: DataFrames in, DataFrames out."""
