"""Point-in-time audit and model-evaluation operators for Spark DataFrames."""
