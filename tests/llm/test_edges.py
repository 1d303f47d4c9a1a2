"""Nulls, empty and very long texts, ties, repeated rows, empty tables, columns with clashing names; components; the pipeline."""

from __future__ import annotations

import uuid

import pytest
from conftest import SF
from pyspark.sql import functions as F

import corpus_pipeline
from codeloom.llm import classifier, common, components, decontaminate, licenses, line_dedup, near_dedup, packing, quality, substring_dedup, token_counts, token_output

LONG = " ".join(f"word{i % 5000}" for i in range(60_000))
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, key string, node string, component int, hash double, row string, r_doc string, now_text string, was_text string, g_key int, label string, trusted int"
ROWS = [(1, "one two three\nfour five six"), (1, "one two three\nfour five six"), (None, "one two three"), (None, None), (2, None), (3, ""), (4, " \n\t "), (5, "!!!"), (6, LONG), (7, "\x00 odd   text"), (8, "word"), (8, "word"), (9, "x" * 50_000)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "en", "s", len(t) if t is not None else None, "k", None, 1, None, "r", "", "n", None, 3, "l", 0) for i, t in ROWS], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (6, 1, 0), (8, 0, 1), (None, 1, 0), (9, None, None), (77, 1, 1)], "doc_id bigint, quality int, toxic int")


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, "four five six"), (2, None), (None, "one two three four five six seven eight nine ten"), (3, "")], "item_id bigint, text string")


def _applied(spark, docs, labels, bench):
    folder = f"{common.shared_dir(spark)}/edges-{uuid.uuid4().hex}"
    return {
        1: lambda d: token_output.write_sequences(d, folder),
        2: lambda d: decontaminate.find_contamination(d, bench),
        3: packing.pack,
        4: near_dedup.near_duplicate_groups,
        5: lambda d: quality.score_documents(d, labels),
        6: licenses.scan,
        7: substring_dedup.repeated_passages,
        8: lambda d: classifier.classify(d, classifier.fit(d, labels, epochs=1)),
        9: token_counts.prefix_counts,
        10: line_dedup.drop_lines,
    }


#: Rows that each operator gives for ROWS.
COUNTS = {1: 13, 2: 2, 4: 2, 5: 13, 6: 0, 7: 0, 8: 13, 9: 13}


def _expected(op: int, got: list) -> None:
    """What the operators say of ROWS, beyond the number of rows."""
    of: dict = {}
    for r in got:
        of.setdefault(r["doc_id"], []).append(r)
    if op == 1:
        assert [r["n_tokens"] for r in of[3] + of[2]] == [0, 0] and all(r["file"] is None for r in of[3] + of[2])
        assert len({r["n_tokens"] for r in of[8]}) == 1 and of[8][0]["n_tokens"] > 0
    elif op == 2:  # the short item in both rows of document 1
        assert [(r["doc_id"], r["item_id"], r["first_word"], r["last_word"], r["n_words"]) for r in got] == [(1, 1, 3, 5, 3)] * 2
    elif op == 4:  # repeated rows are one document that counts twice
        assert {(r["doc_id"], r["group_id"], r["group_size"], r["keep"], r["n"]) for r in got} == {(1, 1, 2, True, 2), (8, 8, 2, True, 2)}
    elif op == 5:
        assert all(r["score"] is None and not r["keep"] for r in of[2] + of[3] + of[4]) and of[5][0]["score"] is not None
        assert len({(r["score"], r["keep"]) for r in of[1]}) == 1
    elif op == 8:
        assert all(r["quality"] is None and not r["keep"] for r in of[2] + of[3] + of[4]) and 0 <= of[6][0]["quality"] <= 1
        assert len({tuple(r) for r in of[8]}) == 1
    elif op == 9:
        assert [(r["n_chars"], r["n_tokens"], r["fit_128"], bytes(r["prefix_table"])) for r in of[3] + of[2]] == [(0, 0, 0, b"")] * 2
        assert of[6][0]["n_chars"] == len(LONG) and of[6][0]["n_tokens"] > 60_000 > of[6][0]["fit_2048"] > of[6][0]["fit_128"] > 0
    elif op == 10:
        texts = [(r["doc_id"], r["text"]) for r in got]
        assert texts.count((1, ROWS[0][1])) == 2 and texts.count((8, "word")) == 2 and (None, "one two three") not in texts
        assert texts.count((None, None)) == 1 and (2, None) in texts and (3, "") in texts and (5, "!!!") in texts and (6, LONG) in texts


@pytest.mark.parametrize("op", range(1, 11))
def test_odd_rows_and_empty_tables(spark, docs, labels, bench, op):
    apply = _applied(spark, docs, labels, bench)[op]
    got = apply(docs).collect()
    if op in COUNTS:
        assert len(got) == COUNTS[op]
    if op == 3:
        assert sum(r["bin"] is None for r in got) == 3 and {r["doc_id"] for r in got} == {i for i, _ in ROWS}
    _expected(op, got)
    if op == 10:
        assert apply(docs).columns == docs.columns
    assert apply(docs.limit(0)).collect() == []


@pytest.mark.parametrize("k", range(5))
def test_stages_with_odd_rows(spark, docs, labels, bench, tmp_path, k):
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    name, stage = corpus_pipeline.STAGES[k]
    out = stage(spark, docs, str(tmp_path))
    rows = out.collect()
    if k < 4:
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        assert len(rows) <= len(ROWS)
    if name == "near dedup":
        texts = [r["text"] for r in rows]
        assert texts.count("word") == 1 and texts.count(ROWS[0][1]) == 1 and texts.count(None) == 2
    if name == "quality rules":
        assert all(r["text"] and r["text"].strip() for r in rows)
    empty = stage(spark, docs.limit(0), str(tmp_path))
    assert empty.collect() == [] and empty.columns == out.columns


def test_components_both_ways(spark):
    edges = [(1, 2), (2, 3), (5, 4), (4, 4), (9, 8), (8, 7), (7, 6), (10, 9), (20, 21), (21, 20), (30, 30)] + [(100 + i, 101 + i) for i in range(30)]
    df = spark.createDataFrame(edges, "a bigint, b bigint")
    one = {(r["node"], r["component"]) for r in components.connected_components(df).collect()}
    stars = {(r["node"], r["component"]) for r in components.connected_components(df, one_task=0).collect()}
    want = {(1, 1), (2, 1), (3, 1), (4, 4), (5, 4), (6, 6), (7, 6), (8, 6), (9, 6), (10, 6), (20, 20), (21, 20)} | {(100 + i, 100) for i in range(31)}
    assert one == stars == want


def test_pipeline_stages_hold_what_they_promise(spark):
    """Each stage over the test documents, against a check by brute force on its own input."""
    docs = common.table(spark, SF, "documents")
    seen = [docs]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        seen.append(common.materialize(stage(spark, seen[-1], SF), name.replace(" ", "-")))
        assert seen[-1].columns == docs.columns and seen[-1].count() <= seen[-2].count()
    raw, good, lined, unique, clean = seen
    scored = quality.score_documents(raw, common.table(spark, SF, "labels"))
    assert sorted(r["doc_id"] for r in good.collect()) == sorted(r["doc_id"] for r in scored.where("keep").collect())
    assert line_dedup.meet(lined).where(F.col("kind") == line_dedup.AGAIN).isEmpty()
    assert near_dedup.near_duplicate_groups(unique).where("group_size > 1").count() <= 0.1 * max(1, near_dedup.near_duplicate_groups(lined).count())
    assert decontaminate.find_contamination(clean, common.table(spark, SF, "benchmark")).isEmpty()
    hit = {r["doc_id"] for r in decontaminate.find_contamination(unique, common.table(spark, SF, "benchmark")).collect()}
    before = {r["doc_id"]: r["text"] for r in unique.collect()}
    after = {r["doc_id"]: r["text"] for r in clean.collect()}
    assert all(after[d] == t for d, t in before.items() if d not in hit)
    packed = corpus_pipeline.STAGES[-1][1](spark, clean, SF)
    counts = {r["doc_id"]: r["n_tokens"] for r in token_counts.prefix_counts(clean).collect()}
    assert {r["doc_id"]: r["n"] for r in packed.groupBy("doc_id").agg(F.sum("n_tokens").alias("n")).collect()} == counts
