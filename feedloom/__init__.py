"""feedloom: content-feed analytics on Spark DataFrames."""
