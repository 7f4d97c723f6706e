"""Retail price analytics on Spark: operators as functions from DataFrames to a DataFrame."""
