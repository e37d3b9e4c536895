"""Sequence-survey analytics on Spark: read, clean, classify, count and compare, as DataFrames."""
