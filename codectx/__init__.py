"""Context retrieval over source code and text, on Spark DataFrames."""
