"""Operators over DataFrames of a catalog."""
