"""Curation and two-way retrieval of text-record corpora on Spark."""
