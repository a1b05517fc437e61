"""Sequence search and training-data operators as Spark DataFrames."""
