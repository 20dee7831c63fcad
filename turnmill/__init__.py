"""Analytics of agent session transcripts on Spark DataFrames."""
