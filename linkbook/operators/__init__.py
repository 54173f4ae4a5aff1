"""Operators: functions from a book (or DataFrames) to a DataFrame."""
