"""Operators of a training-data pipeline: scans, joins, models and stores over whole corpora."""
