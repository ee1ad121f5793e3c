"""Two-sided contest analytics on Spark DataFrames."""
