"""The engine's operators: functions from a snapshot and parameters to DataFrames."""
