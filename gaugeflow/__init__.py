"""Windowed time-series evaluation on Spark DataFrames."""
