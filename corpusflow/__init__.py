"""Corpus curation, retrieval and operational analytics as Spark DataFrame jobs."""
