"""Spark jobs for entity-by-period performance panels."""
