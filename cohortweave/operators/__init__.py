"""Data operators. Each is a function from DataFrames to a DataFrame."""
