"""Operators over telemetry, windows and predictions; all take and return DataFrames."""
