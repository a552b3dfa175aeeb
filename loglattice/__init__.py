"""Log analytics, structure-aware log compression and corpus preparation on Spark DataFrames."""

__version__ = "0.1.0"
