"""Operators: functions from DataFrames to DataFrames, and builders of columns."""
