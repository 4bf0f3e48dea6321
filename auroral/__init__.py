"""auroral: ordered, multi-variable time-series analytics on Spark DataFrames."""
