"""Profile, context-window and ranking analytics on Spark DataFrames."""
