"""Operators for large-scale training-data preparation: every one maps DataFrames to DataFrames."""
