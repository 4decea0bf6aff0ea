"""rostrum: corpus and panel analytics on Spark DataFrames."""
