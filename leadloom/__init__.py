"""Lead discovery and qualification jobs on Spark DataFrames."""
