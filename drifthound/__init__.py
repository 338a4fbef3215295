"""Process-conformance analytics on Spark DataFrames."""
