"""Gaussian-splat scene analytics on Spark DataFrames."""
