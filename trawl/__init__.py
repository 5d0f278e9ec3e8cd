"""Corpus search on Spark DataFrames."""
