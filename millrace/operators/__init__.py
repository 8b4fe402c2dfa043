"""Load operators: functions from DataFrames to DataFrames."""
