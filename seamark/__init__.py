"""Ship-tracking analytics as plain functions from DataFrames to DataFrames."""
