"""corpusflow: corpus preparation and batch retrieval on Spark DataFrames."""

__version__ = "0.1.0"
