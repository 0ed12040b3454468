"""Batch operators: functions from DataFrames to a DataFrame, with their queries and DuckDB equivalents."""
