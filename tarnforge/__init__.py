"""Retrieval analytics and corpus preparation on Spark DataFrames."""
