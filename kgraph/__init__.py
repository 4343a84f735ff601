"""Concept-graph analytics over transcript corpora, on Spark DataFrames."""
