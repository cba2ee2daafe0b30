"""Network analytics on Spark DataFrames."""
