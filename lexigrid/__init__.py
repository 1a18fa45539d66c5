"""lexigrid: word n-gram analytics on Spark DataFrames."""
