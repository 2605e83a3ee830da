"""Catalog operators: DataFrames in, DataFrames out."""
