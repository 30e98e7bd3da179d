"""Tramline: trajectory and corpus analytics on Spark DataFrames."""
