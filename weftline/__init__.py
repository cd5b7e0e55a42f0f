"""weftline: literature-discovery and data-quality analytics on Spark DataFrames."""

__version__ = "0.1.0"
