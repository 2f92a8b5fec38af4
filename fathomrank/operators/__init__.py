"""Ranking operators over DataFrames."""
