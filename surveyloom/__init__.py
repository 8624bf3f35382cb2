"""Survey-panel analytics on Spark DataFrames."""
