"""Relational operators of the fusion engine, each a function from DataFrames to a DataFrame."""
