"""Operators on cases, pieces, parties and actions: DataFrames in, DataFrames out."""
