"""Eventloom: longitudinal event sequences on Spark DataFrames."""
