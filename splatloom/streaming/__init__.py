"""Structured Streaming over event streams of poses."""
