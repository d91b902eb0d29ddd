"""Record linkage operators: functions from DataFrames to DataFrames."""
