"""Cadenza: catalogue analytics on Spark DataFrames."""
