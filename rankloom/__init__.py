"""rankloom: retrieval and ranking analytics as plain functions from DataFrames to DataFrames."""
