"""Market-monitoring analytics on Spark DataFrames and streams."""
