"""Data profiling, key checks and catalog documentation for Spark DataFrames."""
