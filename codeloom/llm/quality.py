"""5. Quality rules: hashed n-gram log-likelihood ratio of trusted target against raw corpus."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

BUCKETS = 1 << 18
ALPHA = 1.0
#: Share of trusted documents, held out of the target, that the threshold must keep.
KEEP_SHARE = 0.995


_known: dict[str, int] = {}
common.remembers(_known.clear)


def _hash(word: str) -> int:
    """The first four bytes of the MD5, remembered for the words that a worker meets first."""
    h = int.from_bytes(hashlib.md5(word.encode()).digest()[:4], "big")
    if len(_known) < common.REMEMBERED and len(word) < 64:
        _known[word] = h
    return h


def buckets_of(text: pa.Array, buckets: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Bucket and row of every word and every pair of neighbouring words, as written (case and marks count)."""
    w = common.Words(text, lower=False)
    h = np.fromiter((_known.get(v) or _hash(v) for v in w.vocab), np.uint64, len(w.dictionary))
    flat, rows = h[w.codes], w.rows()
    ok = common.window_ok(w.bounds, 2)
    with np.errstate(over="ignore"):
        pairs = (flat[:-1] * np.uint64(1_000_003) + flat[1:])[ok] if len(flat) > 1 else flat[:0]
    both = np.concatenate([flat, pairs]) % np.uint64(buckets)
    return both.astype(np.int64), np.concatenate([rows, rows[:-1][ok] if len(flat) > 1 else rows[:0]]), len(w.bounds) - 1


def trusted_ids(labels: DataFrame) -> DataFrame:
    """``doc_id, fits``: documents that some label row calls good and not toxic; null labels trust nothing.

    Half of them, by a hash of the id, make the target; the others are held out to set the threshold.
    """
    ids = labels.where((F.col("quality") == 1) & (F.col("toxic") == 0) & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("bigint").alias("doc_id")).distinct()
    return ids.withColumn("fits", F.md5(F.col("doc_id").cast("string")) < "8")


def count_ngrams(docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """``bucket, raw, target``: n-grams of all documents, and of the trusted ones that fit, by hash bucket.

    Each task counts into arrays and sends its nonzero buckets; the sums are taken by a shuffle on the bucket.
    """
    ids = common.small(trusted.where("fits"), 16)
    flagged = common.project(docs).join(ids.select("doc_id", F.lit(True).alias("trusted")), "doc_id", "left").select("text", F.coalesce("trusted", F.lit(False)).alias("trusted"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
        for batch in common.pieces(batches):
            b, rows, n = buckets_of(batch.column("text"), buckets)
            raw += np.bincount(b, minlength=buckets)
            good = batch.column("trusted").to_numpy(zero_copy_only=False).astype(bool)
            if n and good.any():
                target += np.bincount(b[good[rows]], minlength=buckets)
        at = np.flatnonzero(raw)
        for k in range(0, len(at), 100_000):
            part = at[k : k + 100_000]
            yield pa.record_batch([pa.array(part.astype(np.int32)), pa.array(raw[part]), pa.array(target[part])], names=["bucket", "raw", "target"])

    return common.mapped(flagged, run, "bucket int, raw bigint, target bigint").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))


def fit(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, alpha: float = ALPHA) -> np.ndarray:
    """Log ratio of the two smoothed multinomials for every bucket. Its size is ``buckets``, whatever the corpus."""
    counts = count_ngrams(docs, trusted_ids(labels), buckets).toArrow()
    raw, target = np.zeros(buckets), np.zeros(buckets)
    at = counts.column("bucket").to_numpy()
    raw[at], target[at] = counts.column("raw").to_numpy(), counts.column("target").to_numpy()
    return np.log((target + alpha) / (target.sum() + alpha * buckets)) - np.log((raw + alpha) / (raw.sum() + alpha * buckets))


def scorer(spark: SparkSession, model: np.ndarray):
    """Arrow UDF: mean log ratio of a text's n-grams; null for a text without words."""
    shared, buckets = spark.sparkContext.broadcast(model), len(model)

    def means(text: pa.Array) -> pa.Array:
        b, rows, n = buckets_of(text, buckets)
        size = np.bincount(rows, minlength=n)
        total = np.bincount(rows, weights=shared.value[b], minlength=n)
        return pa.array(total / np.maximum(size, 1), pa.float64(), mask=size == 0)

    @F.arrow_udf("double")
    def score(text: pa.Array) -> pa.Array:
        common.takes_over(__name__)
        return common.in_pieces(text, means)

    return score


def threshold(docs: DataFrame, labels: DataFrame, score, keep_share: float = KEEP_SHARE) -> float | None:
    """The score that ``keep_share`` of the held-out trusted documents reach, over all of them, to four places.

    None if there is no such document; then nothing with words is rejected.
    """
    held = common.small(trusted_ids(labels).where("not fits").select("doc_id"), 16)
    scores = common.project(docs).join(held, "doc_id", "left_semi").select(F.round(score("text"), 4).alias("score"))
    cut = scores.agg(F.percentile("score", 1 - keep_share)).first()[0]
    return None if cut is None else round(cut, 4)


def _rejects(score, cut: float | None):
    return score.isNull() if cut is None else F.coalesce(score < cut, F.lit(True))


def score_documents(docs: DataFrame, labels: DataFrame, keep_share: float = KEEP_SHARE, buckets: int = BUCKETS, alpha: float = ALPHA) -> DataFrame:
    """``doc_id, score, keep`` for every document.

    ``score`` is the mean, over a document's words and word pairs, of log(p_target / p_raw), rounded to six
    places; ``keep`` is score >= threshold. The threshold is one number for all documents, set so that
    ``keep_share`` of the trusted documents that were held out of the target pass. Without trusted documents
    ratios come from smoothing alone and everything with words is kept.

    Nulls: a null, empty or blank text has a null score and is not kept. Null doc_ids are never trusted but are
    scored. Repeated rows count and are scored as often as they occur. Empty tables give empty results. A very long
    text costs its own size in memory; others are taken together up to ``common.PIECE`` bytes.
    """
    score = scorer(docs.sparkSession, fit(docs, labels, buckets, alpha))
    cut = threshold(docs, labels, score, keep_share)
    return common.project(docs).select("doc_id", F.round(score("text"), 6).alias("score")).withColumn("keep", ~_rejects(F.col("score"), cut))


def keep_good(docs: DataFrame, labels: DataFrame, keep_share: float = KEEP_SHARE, buckets: int = BUCKETS, alpha: float = ALPHA) -> DataFrame:
    """The rows of ``docs``, all columns, that :func:`score_documents` keeps; repeated rows stay or go together.

    Null, empty and blank texts go; null doc_ids are scored like others; empty tables give empty results.
    """
    score = scorer(docs.sparkSession, fit(docs, labels, buckets, alpha))
    cut = threshold(docs, labels, score, keep_share)
    return docs.where(~_rejects(F.round(score(F.coalesce(F.col("text").cast("string"), F.lit(""))), 6), cut))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))


#: Common table expressions that end in ``scored(doc_id, score)`` over ``documents`` and ``labels``.
CTES = f"""
words AS (SELECT doc_id, list_transform(list_filter(regexp_split_to_array(coalesce(text, ''), '[\\s\\x0b\\x1c-\\x1f\\x{{85}}\\p{{Z}}]+'), lambda x: x <> ''), lambda x: ('0x' || substr(md5(x), 1, 8))::BIGINT) AS h FROM documents),
grams AS (
  SELECT doc_id, unnest(list_concat(list_transform(h, lambda x: x % {BUCKETS}), list_transform(range(1, len(h)), lambda i: (h[i] * 1000003 + h[i + 1]) % {BUCKETS}))) AS b FROM words),
trusted AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 1 AND toxic = 0 AND doc_id IS NOT NULL),
good AS (SELECT doc_id FROM trusted WHERE md5(doc_id::VARCHAR) < '8'),
counted AS (SELECT b, count(*) AS raw, count(*) FILTER (WHERE good.doc_id IS NOT NULL) AS target FROM grams LEFT JOIN good USING (doc_id) GROUP BY b),
total AS (SELECT coalesce(sum(raw), 0) AS raw, coalesce(sum(target), 0) AS target FROM counted),
ratio AS (SELECT b, ln((c.target + {ALPHA}) / (t.target + {ALPHA * BUCKETS})) - ln((c.raw + {ALPHA}) / (t.raw + {ALPHA * BUCKETS})) AS r FROM counted c, total t),
means AS (SELECT doc_id, round(avg(r), 6) AS score FROM grams JOIN ratio USING (b) GROUP BY doc_id),
scored AS (SELECT d.doc_id, m.score FROM documents d LEFT JOIN means m USING (doc_id)),
held AS (SELECT round(avg(r), 4) AS score FROM grams JOIN ratio USING (b) WHERE doc_id IN (SELECT doc_id FROM trusted WHERE md5(doc_id::VARCHAR) >= '8') GROUP BY doc_id),
cut AS (SELECT round(quantile_cont(score, {1 - KEEP_SHARE}), 4) AS c FROM held)
"""
ORACLE = f"WITH {CTES} SELECT doc_id, score, coalesce(score >= coalesce(c, -1e9), false) AS keep FROM scored, cut"
