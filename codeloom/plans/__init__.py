"""Whole pipelines, and the catalogue of queries: ``QUERIES`` and their SQL, ``ORACLES``."""

from codeloom.plans import changes, parsers, texts  # noqa: F401  (they register their queries)
from codeloom.plans.catalogue import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
