"""Every query of the catalogue that has SQL, against DuckDB on the same tables."""

from __future__ import annotations

import pytest

from codeloom.plans import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(same_rows, name):
    same_rows(QUERIES[name], ORACLES[name])
