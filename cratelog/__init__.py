"""Audio-catalogue analytics on Spark DataFrames."""
