"""Operators: functions from DataFrames to DataFrames, always over all runs at once."""
