"""A layered text-memory engine on Spark DataFrames."""
