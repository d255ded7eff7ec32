"""Distributed table operators: DataFrames and parameters in, DataFrames out."""
