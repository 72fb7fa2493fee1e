"""Pipelines over raw lines and tables, compiled to Spark DataFrames."""
