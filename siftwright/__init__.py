"""Corpus curation and evaluation analytics on Spark DataFrames."""
