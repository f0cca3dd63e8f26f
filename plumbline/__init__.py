"""Evaluation analytics on Spark: curation, scoring, records, ranking and serving as DataFrame operations."""
