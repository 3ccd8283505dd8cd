"""Set-based used-vehicle market analytics on Spark DataFrames."""
