"""kinetext: text as motion through embedding space, on Spark DataFrames."""

__version__ = "0.1.0"
