"""Live-chat stream analytics on Spark DataFrames and Structured Streaming."""
