"""Stages of the pipeline against brute force, each on its own input, and the operators on what SQL does not say."""

from __future__ import annotations

import itertools
import random

import numpy as np
import pyarrow as pa
import pytest
from conftest import SF
from test_operators import _edited, _kept_lines, _sets, _similar, prose, table

import corpus_pipeline
from codeloom.llm import classifier, common, near_dedup, quality, tokenizer

STAGES = dict(corpus_pipeline.STAGES)
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def _documents(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], SCHEMA)


def test_line_dedup_stage(spark):
    rng = random.Random(21)
    lines = [prose(2000 + k, rng.choice((2, 4, 8, 20, 50))) for k in range(30)]
    rows = []
    for d in range(40):
        own = [_edited(rng, x, rng.choice((0, 0, 1, len(x) // 25))) for x in rng.sample(lines, 3)]
        rows.append((d, "\n".join([*own, prose(3000 + d, 12), ""])))
    rows += [(50, None), (51, ""), (52, "\n\n"), (None, lines[0])]
    got = {r["doc_id"]: r for r in STAGES["line dedup"](spark, _documents(spark, rows), SF).collect()}
    want = _kept_lines(rows, _similar)
    wrong = [d for d in {**want, **got} if (got[d]["text"] if d in got else "gone") != want.get(d, "gone")]
    assert len(wrong) <= 1, wrong  # a similar pair in ten may be missed where edits are many
    assert all(r["n_chars"] == len(r["text"]) for r in got.values() if r["text"] is not None)


def test_near_dedup_stage(spark):
    rng = random.Random(22)
    base = [prose(4000 + k, rng.choice((30, 80, 300))) for k in range(12)]
    rows = [(k, t) for k, t in enumerate(base)]
    for k, t in enumerate(base[:8]):
        for copy in range(k % 4 + 1):
            ws = t.split()
            for _ in range(max(1, len(ws) // 25) if copy else 0):
                ws[rng.randrange(len(ws))] = prose(rng.randrange(10**6), 1)
            rows.append((100 + 10 * k + copy, " ".join(ws)))
    sets = _sets([t for _, t in rows])
    root = list(range(len(rows)))
    for i, j in itertools.combinations(range(len(rows)), 2):
        if len(sets[i] & sets[j]) >= near_dedup.SIMILARITY * len(sets[i] | sets[j]):
            a, b = root[i], root[j]
            root = [min(a, b) if r in (a, b) else r for r in root]
    want = sorted(min(rows[k][0] for k in range(len(rows)) if root[k] == g) for g in set(root))
    got = sorted(r["doc_id"] for r in STAGES["near dedup"](spark, _documents(spark, rows), SF).collect())
    assert got == want and len(want) == 12


def test_run_is_its_stages(spark):
    """``run`` over the test tables covers every token that the stages before left, in bins that hold."""
    rows = corpus_pipeline.run(spark, SF).collect()
    used: dict = {}
    for r in rows:
        if r["bin"] is not None:
            used.setdefault(r["bin"], []).append(r)
    assert used and all(sum(r["n_tokens"] for r in m) == m[0]["bin_used"] <= 2048 for m in used.values())
    assert {r["doc_id"] for r in rows} <= {r["doc_id"] for r in common.table(spark, SF, "documents").select("doc_id").collect()}


def test_a_worker_forgets_what_another_operator_remembered(spark):
    def keeps(batches):
        for batch in batches:
            quality.buckets_of(batch.column("text"), 64)
            tokenizer.token_counts(batch.column("text"))
            yield pa.record_batch([pa.array([len(quality._known)]), pa.array([tokenizer.counter.cache_info().currsize])], names=["words", "counters"])

    def looks(batches):
        for _ in batches:
            yield pa.record_batch([pa.array([len(quality._known)]), pa.array([tokenizer.counter.cache_info().currsize])], names=["words", "counters"])

    looks.__module__ = "another"
    text = _documents(spark, [(1, prose(77, 50))]).select("text").repartition(1)
    both = common.mapped(text, keeps, "words bigint, counters bigint")
    assert min(both.first()) > 0
    for _ in range(8):  # whichever idle worker takes it
        assert max(common.mapped(text, looks, "words bigint, counters bigint").first()) == 0


def test_every_task_slot_collects_garbage_before_a_stage(spark):
    assert common.give_back(spark) == spark.sparkContext.defaultParallelism
    for name, stage in STAGES.items():
        assert "give_back" in stage.__code__.co_names, name


# 8: the classifier, plainly


def _plain_logits(p: dict, x: classifier.Passages) -> list[np.ndarray]:
    """Head by head and passage by passage, without arrays over documents."""
    out = []
    for a, b in itertools.pairwise(x.docs.tolist()):
        hidden = []
        for k in range(a, b):
            words = x.codes[x.starts[k] : x.starts[k] + x.lens[k]]
            v = sum(np.r_[p["word"][x.word[c]], p["shape"][x.shape[c]]].astype(np.float64) for c in words) / np.sqrt(x.lens[k])
            hidden.append(np.tanh(np.r_[v, x.extra[k]] @ p["W"] + p["b"]))
        scores = np.array([(np.tanh(h @ p["V"]) / (1 + np.exp(-(h @ p["U"])))) @ p["w"] for h in hidden])
        weights = np.exp(scores) / np.exp(scores).sum(axis=0)
        out.append(np.array([sum(weights[k, head] * h for k, h in enumerate(hidden)) @ p["C"][:, head] + p["c"][head] for head in range(2)]))
    return out


def test_classifier_forward_is_the_plain_one():
    model = classifier.Model.new(3)
    rng = np.random.default_rng(4)
    model.p = {k: v + rng.normal(0, 0.05, v.shape).astype(np.float32) for k, v in model.p.items()}
    x = classifier.Passages(pa.array([prose(1, 10), prose(2, 48), prose(3, 200)]))
    got = model.forward(model.encode(x), x.docs)[-1]
    assert np.allclose(got, np.stack(_plain_logits(model.p, x)), atol=1e-4)


def test_classifier_training_lowers_the_loss_it_states():
    texts = [prose(k, 60) + (" BAD!!! bad" if k % 2 else "") for k in range(40)]
    y = np.array([[1 - k % 2, np.nan if k % 5 == 0 else k % 2] for k in range(40)], float)

    def loss(m):
        prob, _ = m.predict(pa.array(texts))
        prob = np.clip(prob, 1e-6, 1 - 1e-6)
        each = -(np.nan_to_num(y) * np.log(prob) + (1 - np.nan_to_num(y)) * np.log(1 - prob))
        return each[~np.isnan(y)].mean()

    losses = [loss(classifier.train(texts, y, epochs=n)) for n in (0, 4, 60)]
    assert losses[0] > losses[1] > losses[2] and losses[2] < 0.3


@pytest.mark.parametrize("head", [0, 1])
def test_classifier_steps_follow_the_numeric_gradient(head):
    """One Adagrad step at a tiny rate moves the output's bias and weights against the loss's slope."""
    text, y = [prose(5, 120)], np.full((1, 2), np.nan)
    y[0, head] = 1.0
    before = classifier.Model.new(classifier.SEED)
    after = classifier.train(text, y, epochs=1, rate=1e-4)

    def loss(p):
        z = _plain_logits(p, classifier.Passages(pa.array(text)))[0][head]
        return np.log1p(np.exp(-z))

    for name in ("C", "w", "V", "U", "W", "b", "c"):
        moved = after.p[name] - before.p[name]
        flat = np.argsort(-np.abs(moved).ravel())[:3]
        for i in flat:
            at = np.unravel_index(i, moved.shape)
            slopes = []
            for step in (1e-3, -1e-3):
                p = {k: v.astype(np.float64) for k, v in before.p.items()}
                p[name][at] += step
                slopes.append(loss(p))
            slope = (slopes[0] - slopes[1]) / 2e-3
            if abs(slope) > 1e-5:
                assert np.sign(moved[at]) == -np.sign(slope), (name, at)


def test_rows_come_back_the_same(spark):
    rows = [(1, prose(1, 30)), (1, prose(1, 30)), (2, None)]
    assert table(spark, rows).count() == STAGES["decontamination"](spark, _documents(spark, rows), SF).count()
