"""Point-in-time market research and corpus preparation on Spark DataFrames."""
