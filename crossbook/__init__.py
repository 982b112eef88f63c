"""crossbook: cross-venue event-market analytics on Spark DataFrames."""
