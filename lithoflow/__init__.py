"""lithoflow: well-log and technical-document analytics on Spark DataFrames."""
