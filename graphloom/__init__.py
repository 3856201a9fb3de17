"""Dense-cluster graph analytics on Spark DataFrames."""
