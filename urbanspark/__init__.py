"""Urban geo-analytics on Spark DataFrames."""
