"""Parallel-text corpora on Spark: build, deduplicate, template, sample, split, serve and score."""
