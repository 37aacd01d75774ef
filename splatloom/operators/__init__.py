"""Operators over scene tables: DataFrames in, DataFrames out."""
