"""Collation, alignment and verification of ordered text on Spark DataFrames."""

__version__ = "0.1.0"
