"""Tabular cleaning, profiling, SQL, chart data and prediction on Spark DataFrames."""
