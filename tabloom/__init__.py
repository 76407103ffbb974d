"""Table profiling, preparation and model building on Spark DataFrames."""

__version__ = "0.1.0"
