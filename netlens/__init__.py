"""netlens: network-traffic analytics on Spark DataFrames."""
