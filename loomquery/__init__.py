"""Loomquery: an analytics engine on Spark DataFrames."""
