"""Segmentation and look-alike search on Spark DataFrames."""

__version__ = "0.1.0"
