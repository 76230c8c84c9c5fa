"""Response analytics on Spark DataFrames.

Operators take DataFrames and column names and return DataFrames; the work stays
on the executors. See README.md for the map from task to function.
"""
