"""Operators: each takes and returns DataFrames and holds no session state."""
