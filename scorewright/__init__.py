"""Scoring, cascading, cost accounting and operational analytics on Spark DataFrames."""
