"""Spark jobs over weighted directed graphs."""
