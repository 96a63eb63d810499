"""Analytics over noisy text records, built on Spark DataFrames."""
