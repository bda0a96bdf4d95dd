"""Operators for preparing training data: documents in, DataFrames out."""
