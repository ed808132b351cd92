"""Relational operators of the evidence graph; each takes and returns DataFrames."""
