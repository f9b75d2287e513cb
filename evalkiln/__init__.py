"""Leakage-safe evaluation and prediction analytics on Spark DataFrames."""
