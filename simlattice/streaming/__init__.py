"""Continuous ingestion. Clustering itself is a batch job: complete linkage can't be updated row by row."""
