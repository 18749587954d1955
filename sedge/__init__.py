"""Document-analytics engine on Spark DataFrames."""
