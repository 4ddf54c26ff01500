"""Structural comparison of two snapshots of a hierarchical corpus, on Spark DataFrames."""
