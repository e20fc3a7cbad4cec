"""Panels, features and clustering on Spark DataFrames."""
