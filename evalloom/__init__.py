"""Analytics for evaluation campaigns, built on Spark DataFrames."""
