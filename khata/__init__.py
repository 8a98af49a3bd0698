"""khata: corpus analytics on Spark DataFrames."""
