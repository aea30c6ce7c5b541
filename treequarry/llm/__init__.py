"""Operators of training-data pipelines, each a function of Spark DataFrames."""
