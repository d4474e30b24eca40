"""A corpus data engine on Spark DataFrames."""
