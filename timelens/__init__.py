"""Analytics over time-anchored, multi-modal records, on Spark DataFrames."""
