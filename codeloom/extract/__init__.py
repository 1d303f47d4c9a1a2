"""Extractors: text of a file -> records of its structure."""
