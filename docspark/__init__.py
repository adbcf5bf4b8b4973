"""A Spark engine whose rows are wiki and documentation pages."""
