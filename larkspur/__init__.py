"""Larkspur: an embedded-SQL dialect and its analytic operators on Spark DataFrames."""

__version__ = "0.1.0"
