"""Operators: every one takes DataFrames and returns DataFrames."""
