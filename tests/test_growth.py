"""What a join or a shuffle handles grows as its input does, and not as the square of it."""

from __future__ import annotations

import pytest
from conftest import SF
from pyspark.sql import functions as F

from codeloom.operators import graph, resolve
from codeloom.plans import catalogue
from codeloom.sources import testgraph


def _plans(plan):
    if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
        yield from _plans(plan.executedPlan())
        return
    yield plan
    if plan.getClass().getSimpleName().endswith("QueryStageExec"):
        yield from _plans(plan.plan())
    for k in range(plan.children().size()):
        yield from _plans(plan.children().apply(k))


def most_joined(df, kind: str = "Join") -> int:
    """Rows that the largest join of a plan gives, once it has run."""
    # the executed plan of the DataFrame itself: collect would plan a copy
    df._jdf.queryExecution().executedPlan().executeCollect()
    found = [p.metrics().apply("numOutputRows").value() for p in _plans(df._jdf.queryExecution().executedPlan()) if kind in p.getClass().getSimpleName()]
    assert found
    return max(found)


def most_generated(df) -> int:
    return most_joined(df, "Generate")


def test_inheritance_of_one_name_grows_with_its_askers(spark):
    n = 300
    symbols = spark.range(n).selectExpr("'Base' AS name", "concat('lib/', lpad(id, 4, '0'), '.py') AS file", "'class' AS kind", "id AS ord")
    wanted = spark.range(n).selectExpr("concat('class:a', id) AS source", "'Base' AS parent", "'extends' AS how")
    made = resolve.inheritance(wanted, symbols)
    assert {(r["target"], r["type"]) for r in made.collect()} == {("class:lib/0000.py:Base", "inherits")} and made.count() == n
    assert most_joined(made) == n


def test_fuzzy_names_meet_only_what_they_match(spark):
    names = ["part_%03d" % k for k in range(300)] + ["xpart_007y", "Part", "PA_RT", "café_007"]
    asked = ["PART_%03d" % k for k in range(0, 300, 3)] + ["PAR", "par", "PART", "Part_00", "rt_0", "ART", "CAFÉ", "zz", "é_0"]
    known = spark.createDataFrame([(n,) for n in names], "name string")
    want = spark.createDataFrame([(a, "call") for a in asked], "symbol string, ref_type string")

    def rule(symbol: str, name: str) -> float | None:
        low, other = symbol.lower(), name.lower()
        if low.replace("_", "") == other.replace("_", ""):
            return 0.5 if low == other else 0.4
        if len(symbol) >= 3 and other.startswith(low):
            return 0.35
        return 0.3 if len(symbol) >= 4 and low in other else None

    found = resolve.fuzzy_matches(want, known)
    every = {(a, n): rule(a, n) for a in asked for n in names}
    assert {(r["symbol"], r["name"]): r["confidence"] for r in found.collect()} == {pair: c for pair, c in every.items() if c is not None}
    assert most_joined(resolve.fuzzy_matches(want.where("symbol LIKE 'PART\\\\_%'"), known)) <= 100 + 10


def test_the_first_file_of_a_name_that_is_not_the_asking_one(spark):
    symbols = spark.createDataFrame([("f", "b.py", "function", 2), ("f", "a.py", "function", 1), ("f", "c.py", "function", 3), ("own", "d.py", "function", 4)], "name string, file string, kind string, ord int")
    exports = spark.createDataFrame([("e.py", "F", 1), ("e.py", "own", 5)], "file string, name string, ord int")
    asks = spark.createDataFrame([(s, n, "call") for n in ("f", "own") for s in ("a.py", "b.py", "d.py", "e.py")], "source_file string, symbol string, ref_type string")
    got = {(r["source_file"], r["symbol"]): r["target_file"] for r in resolve.by_name(asks, symbols, exports).collect()}
    assert got == {("a.py", "f"): "b.py", ("b.py", "f"): "a.py", ("d.py", "f"): "a.py", ("e.py", "f"): "a.py", ("a.py", "own"): "d.py", ("b.py", "own"): "d.py", ("d.py", "own"): "e.py", ("e.py", "own"): "d.py"}


def test_places_in_layers_do_not_lengthen_with_depth(spark):
    """Five chains, each of whose nodes also leads to one of two ends that lead nowhere; one end waits for a circle."""
    ids = [f"c{k}.{d}" for d in range(9) for k in range(5)] + ["end0", "end1", "x", "y"]
    links = [(f"c{k}.{d}", f"c{k}.{d + 1}") for d in range(8) for k in range(5)] + [(f"c{k}.{d}", f"end{k % 2}") for d in range(9) for k in range(5)] + [("x", "y"), ("y", "x"), ("y", "end1"), ("nowhere", "end0")]
    n = spark.createDataFrame([(i, "function", k) for k, i in enumerate(ids)], "id string, type string, ord bigint")
    e = spark.createDataFrame([(a, b, k) for k, (a, b) in enumerate(links)], "source string, target string, ord bigint")
    got = [sorted(graph.topological_order(n, e, one_task=limit).collect(), key=lambda r: (r["layer"] is None, r["layer"] or 0, list(r["trail"]))) for limit in (1000, 0)]
    assert [r["id"] for r in got[0]] == [r["id"] for r in got[1]] and {r["id"] for r in got[1] if r["layer"] is None} == {"end1", "x", "y"}
    assert max(len(r["trail"]) for r in got[1]) == 2 and max(r["layer"] or 0 for r in got[1]) == 9


@pytest.mark.parametrize("name", ["java_classes", "typescript_functions", "typescript_imports", "sql_definitions", "python_extract", "env_vars"])
def test_texts_are_dealt_out_before_they_are_parsed(spark, monkeypatch, name):
    monkeypatch.setattr(testgraph, "DEALT_KEYS", 10)
    monkeypatch.setattr(testgraph, "DEALT_ROWS", 50)
    assert catalogue.QUERIES[name](spark, SF).rdd.getNumPartitions() >= 8


def test_imports_meet_files_under_few_stems(spark):
    n = 200
    files = [f"pkg/sub{k}" + (".py", "/__init__.py", ".pyi")[k % 3] for k in range(n)] + ["pkg/sub0/__init__.py", "src/a/near.py", "src/a/up.d.ts", "src/b.ts", "b.js"]
    imports = [("src/a/main.py", f"pkg.sub{k}", "python") for k in range(n)] + [("src/a/main.py", "near", "python"), ("src/a/x.ts", "./up", "typescript"), ("src/a/x.ts", "../b", "typescript"), ("src/a/x.ts", "../../b.js", "javascript"), ("src/a/x.ts", "../../../b", "typescript"), ("src/a/x.rb", "near", "ruby"), ("src/a/x.rb", "none", None)]
    f, i = spark.createDataFrame([(x,) for x in files], "path string"), spark.createDataFrame(imports, "file string, source string, language string")
    made = resolve.imports_to_files(i, f)
    got = {(r["file"], r["source"]): r["target"] for r in made.collect()}
    assert got == {**{("src/a/main.py", f"pkg.sub{k}"): files[k] for k in range(n)}, ("src/a/main.py", "near"): "src/a/near.py", ("src/a/x.ts", "./up"): "src/a/up.d.ts", ("src/a/x.ts", "../b"): "src/b.ts", ("src/a/x.ts", "../../b.js"): "b.js", ("src/a/x.rb", "near"): "src/a/near.py"}
    every = resolve._import_candidates("python")
    assert i.where("language = 'python'").select(F.size(every).alias("n")).first()["n"] > 30
    python = resolve._first_hit(i.where("language = 'python'"), resolve._known_files(f), ["file", "source"], every)
    assert most_generated(python) <= 5 * (n + 1)


def test_edges_are_made_once_for_all_rounds(spark):
    read = spark.sparkContext.accumulator(0)
    links = [(f"n{k}", f"n{k + 1}", "calls", k) for k in range(6)]

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    edges = spark.createDataFrame(links, "source string, target string, type string, ord bigint")
    edges = edges.mapInArrow(counted, edges.schema)
    assert graph.shortest_path(edges, "n0", "n6", max_depth=None).count() == 7
    assert read.value == len(links)
