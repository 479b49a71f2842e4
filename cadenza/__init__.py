"""Song-similarity and catalog analytics on Spark DataFrames."""
