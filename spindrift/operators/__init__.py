"""Keyed writes, arrays of children, scored matching and set operations on DataFrames."""
