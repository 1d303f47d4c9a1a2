"""Typed property graphs of software projects on Spark DataFrames."""
