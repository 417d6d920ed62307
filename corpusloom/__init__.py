"""Corpus analytics on Spark: cleaning, deduplication, tokenisation, splits and metrics."""
