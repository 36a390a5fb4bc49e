"""inkweave: document graphs, hybrid search and training-data preparation on Spark DataFrames."""
