"""Scene tables: views derived from stored tables, and readers and writers of splat files."""
