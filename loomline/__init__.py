"""Trajectory and corpus analytics on Spark DataFrames."""
