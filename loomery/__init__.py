"""Set-oriented knowledge retrieval, graph and learning analytics on Spark DataFrames."""
