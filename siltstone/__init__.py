"""Siltstone: versioned, multi-column keyed data resolved with Spark DataFrames."""
