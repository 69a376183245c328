"""Operators on event and signal tables: DataFrames in, DataFrames out."""
