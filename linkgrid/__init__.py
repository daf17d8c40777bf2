"""Sparse, geospatial network-quality analytics as PySpark DataFrame transforms."""

__version__ = "0.1.0"
