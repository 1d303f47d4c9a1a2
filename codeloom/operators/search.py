"""Search: by similar names, by words (BM25), by substring, and by embedding."""

from __future__ import annotations

import math
from functools import reduce

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.functions import similarity

NAME_WEIGHTS = {"name": 2.0, "summary": 0.8, "tags": 2.5}
ENGINE_WEIGHTS = {"name": 2.0, "tags": 2.5, "summary": 0.8, "language_notes": 1.0}
K1, B = 1.2, 0.75
_NOT_WORD = r"[^\p{L}\p{N}]+"


def _against(query: str, score, cut: float | None = None):
    """Arrow UDF: score of each string against ``query``; equal strings of a batch are scored once."""

    @F.arrow_udf("double")
    def run(text: pa.Array) -> pa.Array:
        coded = text.dictionary_encode()
        made = [None if t is None else score(query, t) for t in coded.dictionary.to_pylist()]
        return pa.array(made, pa.float64()).take(coded.indices)

    return run


def fuzzy_strings(rows: DataFrame, column: str, query: str, threshold: float = 60.0, limit: int = 20, case_sensitive: bool = False) -> DataFrame:
    """Rows whose ``column`` is similar to ``query`` word by word, best first (ties by ``ord``); ``limit`` 0 for all."""
    text = F.col(column) if case_sensitive else F.lower(column)
    wanted = query if case_sensitive else query.lower()
    found = rows.withColumn("score", _against(wanted, similarity.token_sort_ratio)(text)).where(F.col("score") >= threshold)
    return found.orderBy(F.desc("score"), "ord").limit(limit) if limit > 0 else found


def fuzzy_nodes(nodes: DataFrame, query: str, threshold: float = 60.0, limit: int = 20, case_sensitive: bool = False, search_tags: bool = True) -> DataFrame:
    """``id, score, key``: nodes of which name, summary or tags are similar to ``query``.

    A field counts if its similarity reaches ``threshold``; it is then weighted, and the best field (the earlier of
    equal ones) speaks for the node, so that scores can pass 100. Blank fields never match.
    """
    keys = ["name", "summary"] + (["tags"] if search_tags else [])
    wanted = query if case_sensitive else query.lower()
    score = _against(wanted, similarity.token_sort_ratio)
    fields = {"name": F.col("name"), "summary": F.col("summary"), "tags": F.array_join("tags", " ")}
    df = nodes.select("id", "ord", *[F.nullif(fields[k] if case_sensitive else F.lower(fields[k]), F.lit("")).alias(k) for k in keys])
    df = df.select("id", "ord", *[F.when(F.trim(k) != "", score(F.col(k))).alias(k) for k in keys])
    options = [F.when(F.col(k) >= threshold, F.struct((F.col(k) * NAME_WEIGHTS[k]).alias("score"), F.lit(-i).alias("turn"), F.lit(k).alias("key"))) for i, k in enumerate(keys)]
    best = df.select("id", "ord", F.array_max(F.array_compact(F.array(*options))).alias("best")).where("best IS NOT NULL")
    found = best.select("id", F.bround("best.score", 1).alias("score"), F.col("best.key").alias("key"), "ord")
    return (found.orderBy(F.desc("score"), "ord").limit(limit) if limit > 0 else found).drop("ord")


def fuzzy_engine(nodes: DataFrame, query: str, types: list[str] | None = None, limit: int = 50, fields: dict[str, float] | None = None) -> DataFrame:
    """``id, score``: distance (0 best) of nodes to a query of several words, any of which may match.

    For each word of two letters or more: the least weighted distance over the fields in which it is found with at
    least 70 per cent, else 1; the score is their mean. A blank query finds nothing.
    """
    words = [w.lower() for w in query.split() if len(w) >= 2]
    weights = ENGINE_WEIGHTS if fields is None else fields
    kept = nodes if types is None else nodes.where(F.col("type").isin(*types))
    empty = kept.where(F.lit(False)).select("id", F.lit(0.0).alias("score"))
    if not words:
        return empty
    text = {k: F.lower(F.array_join(k, " ") if k == "tags" else F.col(k)) for k in weights}

    @F.arrow_udf("double")
    def distance(*columns: pa.Array) -> pa.Array:
        names = list(weights)
        coded = [c.dictionary_encode() for c in columns]
        tables = []
        for k, c in zip(names, coded):
            made = []
            for t in c.dictionary.to_pylist():
                raw = [similarity.partial_ratio(w, t) if t else 0.0 for w in words]
                made.append([(1 - r / 100) / weights[k] if r >= 70 else 1.0 for r in raw])
            tables.append(made)
        out = []
        codes = [c.indices.to_pylist() for c in coded]
        for row in zip(*codes):
            each = [min([1.0, *(t[i][j] for t, i in zip(tables, row) if i is not None)]) for j in range(len(words))]
            out.append(sum(each) / len(each) if min(each) < 1 else None)
        return pa.array(out, pa.float64())

    found = kept.select("id", "ord", distance(*[text[k] for k in weights]).alias("d")).where("d IS NOT NULL").select("id", F.bround("d", 4).alias("score"), "ord")
    return (found.orderBy("score", "ord").limit(limit) if limit > 0 else found).drop("ord")


def like(nodes: DataFrame, query: str, limit: int = 20) -> DataFrame:
    """Nodes of which name, summary or tags contain ``query`` in any case, the first by id."""
    pattern = f"%{query}%"
    hit = F.col("name").ilike(pattern) | F.col("summary").ilike(pattern) | F.to_json("tags").ilike(pattern)
    return nodes.where(hit).orderBy("id").limit(limit)


def _terms(query: str) -> tuple[list[str], bool]:
    """Words of a query (a trailing * asks for a prefix) and whether all of them must occur."""
    parts = query.split()
    words = [p.lower() for p in parts if p not in ("AND", "OR")]
    clean = [regex.sub(r"[^\p{L}\p{N}*]+", " ", w).split() for w in words]
    return [w for ws in clean for w in ws], "OR" not in parts


def bm25(nodes: DataFrame, query: str, limit: int = 20) -> DataFrame:
    """``id, rank``: nodes whose name, summary and tags hold the query's words, best (least) rank first.

    Words are joined by AND unless the query says OR; ``word*`` matches by prefix. One pass counts documents, their
    mean length and how many hold each word; a second scores the rows that match. Nothing is shuffled but the
    partial sums and the top rows.
    """
    words, every = _terms(query)
    if not words:
        return nodes.where(F.lit(False)).select("id", F.lit(0.0).alias("rank"))
    text = F.lower(F.concat_ws(" ", "name", "summary", F.array_join("tags", " ")))
    tokens = F.filter(F.split(text, _NOT_WORD), lambda t: t != "")

    def count(word: str) -> Column:
        end = word.rstrip("*")
        return F.size(F.filter("tokens", (lambda t: F.startswith(t, F.lit(end))) if word.endswith("*") else (lambda t: t == word)))

    df = nodes.select("id", tokens.alias("tokens")).select("id", F.size("tokens").alias("len"), *[count(w).alias(f"f{i}") for i, w in enumerate(words)])
    totals = df.agg(F.count("*").alias("n"), F.avg("len").alias("mean_len"), *[F.count_if(F.col(f"f{i}") > 0).alias(f"df{i}") for i in range(len(words))])
    hits = [F.col(f"f{i}") > 0 for i in range(len(words))]
    found = df.where(reduce((lambda a, b: a & b) if every else (lambda a, b: a | b), hits)).crossJoin(F.broadcast(totals))

    def part(i: int) -> Column:
        f, d = F.col(f"f{i}"), F.col(f"df{i}")
        idf = F.log((F.col("n") - d + 0.5) / (d + 0.5))
        return F.when(idf <= 0, 1e-6).otherwise(idf) * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("len") / F.col("mean_len")))

    rank = -reduce(lambda a, b: a + b, [part(i) for i in range(len(words))])
    return found.select("id", rank.alias("rank")).orderBy(F.round("rank", 9), "id").limit(limit)


def text_search(nodes: DataFrame, query: str, limit: int = 20) -> DataFrame:
    """:func:`bm25`; where that finds nothing, :func:`like`."""
    ranked = bm25(nodes, query, limit)
    return nodes.join(F.broadcast(ranked), "id").orderBy("rank", "id") if not ranked.isEmpty() else like(nodes, query, limit)


# embeddings


def cosine(column: str, query: list[float]) -> Column:
    """Cosine of an array column with a constant vector, as one generated expression; 0 for a zero vector.

    A vector of another length raises an error.
    """
    size = len(query)
    norm_q = math.sqrt(sum(q * q for q in query))
    at = [F.get(F.col(column), F.lit(i)).cast("double") for i in range(size)]
    dot = reduce(lambda a, b: a + b, [a * F.lit(float(q)) for a, q in zip(at, query)])
    norm = F.sqrt(reduce(lambda a, b: a + b, [a * a for a in at]))
    value = F.when((norm == 0) | F.lit(norm_q == 0), 0.0).otherwise(dot / (norm * F.lit(norm_q or 1.0)))
    return F.when(F.size(column) == size, value).otherwise(F.raise_error(F.lit(f"an embedding has not {size} dimensions")).cast("double"))


def clamped(value: Column) -> Column:
    return F.least(F.greatest(value, F.lit(0.0)), F.lit(1.0))


def by_embedding(rows: DataFrame, query: list[float], column: str = "embedding", threshold: float = 0.5, limit: int = 20, key: str = "ord") -> DataFrame:
    """Rows with ``score`` (cosine held to 0..1) of at least ``threshold``, best first, ties by ``key``."""
    # the least double that rounds up to a threshold would pass a rounded comparison: compare before rounding
    found = rows.withColumn("score", clamped(cosine(column, query))).where(F.col("score") >= threshold)
    found = found.withColumn("score", F.bround("score", 4))
    return found.orderBy(F.desc("score"), key).limit(limit) if limit > 0 else found


def semantic(nodes: DataFrame, embeddings: DataFrame, query: list[float], types: list[str] | None = None, threshold: float = 0.0, limit: int = 50) -> DataFrame:
    """``id, score``: distance (1 - cosine) of the nodes that have an embedding (``node_id, embedding``), least first."""
    kept = nodes if types is None else nodes.where(F.col("type").isin(*types))
    scored = embeddings.select("node_id", clamped(cosine("embedding", query)).alias("sim")).where(F.col("sim") >= threshold)
    found = kept.join(scored, kept["id"] == scored["node_id"]).select("id", F.bround(1 - F.col("sim"), 4).alias("score"), "ord")
    return (found.orderBy("score", "ord").limit(limit) if limit > 0 else found).drop("ord")
