"""Operators: each takes DataFrames and returns DataFrames, lazily and without Python code per row."""
