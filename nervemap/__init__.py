"""Topological data analysis and similarity search on PySpark DataFrames."""

__version__ = "0.1.0"
