"""One small local session for all tests."""

from __future__ import annotations

import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    conf = {
        "spark.master": "local[4]",
        "spark.sql.shuffle.partitions": "2",
        "spark.sql.codegen.wholeStage": "false",  # a thousand small plans: compiling them takes longer than running them
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.session.timeZone": "UTC",
        "spark.driver.host": "127.0.0.1",
    }
    made = SparkSession.builder.config(map=conf).getOrCreate()
    made.sparkContext.setLogLevel("ERROR")
    yield made
    made.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for path in sorted(Path(SF).glob("*.parquet")):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def _plain(value):
    if value is None or value != value:
        return None
    if isinstance(value, float):
        return float(f"{value:.6g}")
    return value.to_pydatetime() if hasattr(value, "to_pydatetime") else value


@pytest.fixture(scope="session")
def same_rows(spark, duck):
    """Check that a query and its SQL give equal columns and equal rows, in any order."""

    def check(query, sql: str) -> None:
        ours, theirs = query(spark, SF), duck.execute(sql)
        names = sorted(ours.columns)
        frame = theirs.df()
        assert names == sorted(frame.columns)
        a = sorted((repr([_plain(r[c]) for c in names]) for r in ours.collect()))
        b = sorted((repr([_plain(x) for x in row]) for row in frame[names].astype(object).itertuples(index=False)))
        assert a == b

    return check
