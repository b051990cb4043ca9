"""Operators for building language-model training data, on Spark DataFrames."""
