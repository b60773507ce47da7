"""Predicates as trees, and the compilation of queries to DataFrames."""
