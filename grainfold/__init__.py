"""Sparse count-matrix analytics as Spark DataFrames."""
