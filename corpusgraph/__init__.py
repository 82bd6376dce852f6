"""Corpus and code-graph analytics as Spark jobs."""
