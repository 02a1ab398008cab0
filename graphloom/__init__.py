"""Property-graph analytics of source code, expressed as Spark DataFrames."""
