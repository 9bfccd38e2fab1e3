"""Suggestion-coverage analytics on Spark DataFrames."""
