"""A Spark engine for captured web content."""
