"""Property graphs with vectors and decaying relevance as Spark DataFrames."""
