"""Operators of a training-data pipeline: filters, joins, scans and encoders over whole corpora."""
