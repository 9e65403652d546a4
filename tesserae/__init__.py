"""Evaluation, curation and benchmark analytics as Spark DataFrames."""
