"""Operators: functions from DataFrames to DataFrames that take column names."""
