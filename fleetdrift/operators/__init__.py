"""Operators on flat model tables: DataFrames in, DataFrames out."""
