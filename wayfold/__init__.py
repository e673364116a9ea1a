"""Trajectory similarity analytics on Spark DataFrames."""
