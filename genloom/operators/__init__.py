"""Relational, interval, graph and statistical operators; every function maps DataFrames to a DataFrame."""
