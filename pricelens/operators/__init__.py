"""Operators over DataFrames that more than one query uses."""
