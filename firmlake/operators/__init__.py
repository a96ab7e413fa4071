"""Relational operators: each takes and gives DataFrames with explicit keys."""
