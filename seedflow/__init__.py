"""Influence analytics on weighted directed graphs, expressed with Spark DataFrames."""
