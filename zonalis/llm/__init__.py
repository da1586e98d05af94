"""Operators for training text: each is a function from DataFrames to a DataFrame. Nothing else in zonalis imports these."""
