"""grovekit: knowledge-tree analytics on Spark DataFrames."""
