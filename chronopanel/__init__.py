"""chronopanel: point-in-time research operators on Spark DataFrames."""

__version__ = "0.1.0"
