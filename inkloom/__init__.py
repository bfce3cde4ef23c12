"""Prose checking and corpus preparation on Spark DataFrames."""
