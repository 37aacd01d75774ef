"""Composed queries and their SQL, by topic."""
