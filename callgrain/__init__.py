"""Call and conversation analytics on Spark DataFrames and Structured Streaming."""
