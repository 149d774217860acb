"""Source-tree evidence analytics on Spark DataFrames."""
