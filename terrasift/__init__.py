"""Spark operators for gridded terrain data and corpus preparation."""
