"""Operators by subject; each takes and returns DataFrames."""
