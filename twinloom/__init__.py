"""Parallel-corpus preparation, subword vocabularies and MT scoring on Spark DataFrames."""
