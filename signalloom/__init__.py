"""Operational-signal analytics for test-execution traces, on Spark DataFrames."""
