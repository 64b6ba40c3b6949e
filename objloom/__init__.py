"""objloom: content-addressed object analytics on Spark DataFrames."""

__version__ = "0.1.0"
