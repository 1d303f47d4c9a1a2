"""2. Benchmark decontamination: a broadcast hash set of test n-grams, verified, spans or documents removed."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

N = 8
#: Words between two hits of one item that still count as the same span (an edited word splits no passage).
GAP = 4
#: Bytes of n-grams in one broadcast set. A larger benchmark has several sets, each broadcast in a pass of its own.
SET_BYTES = 64 << 20
#: Bits of a hash by which most windows are settled with one look into a small table.
LOW = np.uint64((1 << 20) - 1)
_MARKS = regex.compile(r"[^\p{L}\p{N}]")
_WORD = re.compile(r"\S+")


def _hashes(w: common.Words) -> np.ndarray:
    return w.hashes()[w.codes] if len(w.codes) else np.zeros(0, np.uint64)


def benchmark_ngrams(benchmark: DataFrame, n: int = N) -> DataFrame:
    """``hash, words, item_id`` of every n-gram; an item of fewer than ``n`` words is one shorter gram.

    Items without words have none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.pieces(batches):
            w = common.normal_words(batch.column("text"))
            h, out, vocab = _hashes(w), [], w.vocab
            for item, a, b in zip(batch.column("doc_id").to_pylist(), w.bounds[:-1].tolist(), w.bounds[1:].tolist()):
                k = min(n, b - a)
                if k:
                    grams = common.ngram_hashes(h[a:b], k).view(np.int64).tolist()
                    out += [(g, " ".join(vocab[c] for c in w.codes[a + i : a + i + k]), item, k) for i, g in enumerate(grams)]
            cols = list(zip(*out)) if out else [[]] * 4
            yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.int64(), pa.int32()))], names=["hash", "words", "item_id", "size"])

    return common.project(benchmark, "item_id").mapInArrow(run, "hash bigint, words string, item_id bigint, size int").distinct()


class Hits:
    """Finds the grams of one set in texts. ``grams``: a table of hash, words, item_id, size, as arrays side by side."""

    def __init__(self, grams: pa.Table) -> None:
        self.sizes: dict[int, tuple[np.ndarray, np.ndarray, pa.Table]] = {}
        for k in pc.unique(grams.column("size")).to_pylist():
            mine = grams.filter(pc.equal(grams.column("size"), k))
            known = mine.column("hash").to_numpy().view(np.uint64)
            order = np.argsort(known, kind="stable")
            low = np.zeros(int(LOW) + 1, bool)
            low[(known & LOW).astype(np.int64)] = True
            self.sizes[k] = known[order], low, mine.select(["words", "item_id"]).take(pa.array(order)).combine_chunks()

    def find(self, text: pa.Array) -> list[tuple]:
        """(row, item_id, first word, last word + 1) of each verified window."""
        w = common.normal_words(text)
        h, out = _hashes(w), []
        for k, (known, low, grams) in self.sizes.items():
            at = common.ngram_hashes(h, k)
            if not len(at):
                continue
            maybe = np.flatnonzero(low[(at & LOW).astype(np.int64)] & common.window_ok(w.bounds, k))
            first = np.searchsorted(known, at[maybe])
            last = np.searchsorted(known, at[maybe], side="right")
            for i, x, y in zip(maybe[first < last].tolist(), first[first < last].tolist(), last[first < last].tolist()):
                words = w.phrase(i, i + k)
                row = int(np.searchsorted(w.bounds, i, side="right")) - 1
                begin = i - int(w.bounds[row])
                out += [(row, grams.column("item_id")[j].as_py(), begin, begin + k) for j in range(x, y) if grams.column("words")[j].as_py() == words]
        return out


def merged(hits: list[tuple], gap: int) -> list[tuple]:
    """Windows of one row and item that overlap or lie at most ``gap`` words apart, joined."""
    out: list[list] = []
    for row, item, a, b in sorted(hits, key=lambda x: (x[0], x[1] is None, x[1] or 0, x[2], x[3])):
        if out and out[-1][0] == row and out[-1][1] == item and a <= out[-1][3] + gap:
            out[-1][3] = max(out[-1][3], b)
        else:
            out.append([row, item, a, b])
    return [tuple(x) for x in out]


def _sets(benchmark: DataFrame, n: int, set_bytes: int) -> list[DataFrame]:
    """The benchmark's n-grams in sets of about ``set_bytes`` at most, as measured."""
    grams = common.materialize(benchmark_ngrams(benchmark, n), "benchmark")
    total = grams.agg(F.sum(F.octet_length("words") + F.lit(32))).first()[0] or 0
    k = -(-total // set_bytes)
    return [grams.where(F.pmod("hash", F.lit(k)) == i) if k > 1 else grams for i in range(k)]


class _Finder:
    """A set on the workers: broadcast as arrays, made ready once for each worker process."""

    def __init__(self, grams: DataFrame) -> None:
        self.shared = grams.sparkSession.sparkContext.broadcast(grams.toArrow().combine_chunks())

    def find(self, text: pa.Array) -> list[tuple]:
        made = self.shared.__dict__.get("hits")
        if made is None:
            made = self.shared.__dict__["hits"] = Hits(self.shared.value)
        return made.find(text)


def _windows(keyed: DataFrame, sets: list[DataFrame]) -> DataFrame:
    """``o_id, o_key, item_id, a, b`` of the windows of every set in ``keyed`` (``o_id, o_key, text``), each once.

    One pass for each set; what it finds is written, and its broadcast is destroyed before the next.
    """
    found = []
    for grams in sets:
        one = _Finder(grams)

        def run(batches: Iterator[pa.RecordBatch], one: _Finder = one) -> Iterator[pa.RecordBatch]:
            for batch in common.pieces(batches):
                hits = one.find(batch.column("text"))
                rows = pa.array([f[0] for f in hits], pa.int64())
                cols = [batch.column("o_id").take(rows), batch.column("o_key").take(rows), pa.array([f[1] for f in hits], pa.int64()), pa.array([f[2] for f in hits], pa.int32()), pa.array([f[3] for f in hits], pa.int32())]
                yield pa.record_batch(cols, names=["o_id", "o_key", "item_id", "a", "b"])

        found.append(common.materialize(common.mapped(keyed, run, "o_id bigint, o_key bigint, item_id bigint, a int, b int").distinct(), "windows"))
        one.shared.destroy()
    every = found[0]
    for more in found[1:]:
        every = every.union(more)
    return every.distinct()


def find_contamination(docs: DataFrame, benchmark: DataFrame, n: int = N, gap: int = GAP, set_bytes: int = SET_BYTES) -> DataFrame:
    """``doc_id, item_id, first_word, last_word, n_words`` of every passage of a benchmark item in a document.

    Words are lower case without marks and counted from 0; ``last_word`` is the last one inside. A passage is a
    run of verified n-gram hits of one item that overlap or lie at most ``gap`` words apart. Every window of every
    document is looked up. Only documents with hits appear. A benchmark beyond ``set_bytes`` is asked set by set, with
    the same rows.

    Nulls: a null text has no words; a null doc_id or item_id is kept as null. Documents shorter than ``n`` can
    only match items that short. Repeated rows give equal rows once each occurrence; items with equal texts each have
    their rows. Empty tables give none. A very long text costs its own size in memory, other texts are taken together
    up to ``common.PIECE`` bytes.
    """
    schema = "doc_id bigint, item_id bigint, first_word int, last_word int"
    source = common.project(docs)
    sets = _sets(benchmark, n, set_bytes)
    names = ["doc_id", "item_id", "first_word", "last_word"]

    def table(ids: pa.Array, found: list[tuple]) -> pa.RecordBatch:
        return pa.record_batch([ids, *(pa.array([f[i] for f in found], t) for i, t in ((1, pa.int64()), (2, pa.int32()), (3, pa.int32())))], names=names)

    if len(sets) > 1:
        keyed = source.select(F.col("doc_id").alias("o_id"), common.text_key(F.col("text")).alias("o_key"), "text")
        by = _windows(keyed, sets).groupBy("o_id", "o_key", "item_id").agg(F.collect_list(F.struct("a", "b")).alias("spans"))
        times = keyed.groupBy(F.col("o_id").alias("t_id"), F.col("o_key").alias("t_key")).agg(F.count("*").cast("int").alias("times"))
        counted = by.join(times, F.col("o_id").eqNullSafe(F.col("t_id")) & (F.col("o_key") == F.col("t_key"))).select("o_id", "item_id", "spans", F.explode(F.array_repeat(F.lit(1), F.col("times"))))

        def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = [f for i, (item, spans) in enumerate(zip(batch.column("item_id").to_pylist(), batch.column("spans").to_pylist())) for f in merged([(i, item, s["a"], s["b"]) for s in spans], gap)]
                yield table(batch.column("o_id").take(pa.array([f[0] for f in found], pa.int64())), found)

        found = counted.mapInArrow(join, schema)
    elif sets:
        one = _Finder(sets[0])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in common.pieces(batches):
                found = merged(one.find(batch.column("text")), gap)
                yield table(batch.column("doc_id").take(pa.array([f[0] for f in found], pa.int64())), found)

        found = common.mapped(source, run, schema)
    else:
        found = docs.sparkSession.createDataFrame([], schema)
    return found.select("doc_id", "item_id", "first_word", (F.col("last_word") - 1).alias("last_word"), (F.col("last_word") - F.col("first_word")).alias("n_words"))


def _cut(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` without the words of ``spans``, and without the white space that then stands twice."""
    places = [m for m in _WORD.finditer(text) if _MARKS.sub("", m.group().lower())]
    out, at = [], 0
    for a, b in spans:
        begin, end = places[a].start(), places[b - 1].end()
        if end < len(text) and (begin == 0 or text[begin - 1].isspace()):
            while end < len(text) and text[end] in " \t":
                end += 1
        out.append(text[at:begin])
        at = max(at, end)
    return "".join([*out, text[at:]])


def _spans(found: list[tuple], gap: int) -> dict[int, list[tuple[int, int]]]:
    """Row to the stretches that its windows cover, those of one item joined across the gap."""
    by: dict[int, list] = {}
    for row, _, a, b in merged([(r, 0, a, b) for r, _, a, b in merged(found, gap)], 0):
        by.setdefault(row, []).append((a, b))
    return by


def _clean(texts: list[str | None], find: Callable[[pa.Array], list[tuple]], gap: int, remove: str) -> dict[int, str | None]:
    """What becomes of the texts that have passages, by place: cut until none is found, or None where documents go."""
    out: dict[int, str | None] = {}
    todo = [i for i, t in enumerate(texts) if t]
    while todo:
        by = _spans(find(pa.array([out.get(i, texts[i]) for i in todo], pa.string())), gap)
        for row, spans in by.items():
            i = todo[row]
            out[i] = None if remove == "documents" else _cut(out.get(i, texts[i]), spans)
        todo = [] if remove == "documents" else [todo[r] for r in by]
    return {i: None if t is None or not t.strip() else t for i, t in out.items()}


def decontaminate(docs: DataFrame, benchmark: DataFrame, remove: str = "spans", n: int = N, gap: int = GAP, set_bytes: int = SET_BYTES) -> DataFrame:
    """``docs`` with all columns, without benchmark passages.

    ``remove="spans"`` cuts the words of each passage out of ``text`` (again, until none is found: what a cut
    joins can match too), sets ``n_chars`` where there is such a column, and drops documents that consist of
    passages alone; ``remove="documents"`` drops every document with a passage. Other rows stay as they are, null,
    empty and repeated ones too. Empty tables give empty results; an empty benchmark changes nothing. One pass without
    a shuffle; only a benchmark beyond ``set_bytes`` takes a pass a set, then one cut, with the same rows. A very long
    text costs its own size in memory.
    """
    if remove not in ("spans", "documents"):
        raise ValueError(remove)
    sets = _sets(benchmark, n, set_bytes)
    if not sets:
        return docs
    if len(sets) > 1:
        return _decontaminate_by_sets(docs, sets, remove, gap)
    one, place, sized = _Finder(sets[0]), docs.columns.index("text"), docs.columns.index("n_chars") if "n_chars" in docs.columns else -1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.pieces(batches):
            texts = batch.column(place).to_pylist()
            changed = _clean(texts, one.find, gap, remove)
            if changed:
                cols = list(batch.columns)
                cols[place] = pa.array([changed.get(i, t) for i, t in enumerate(texts)], cols[place].type)
                if sized >= 0:
                    mask = np.zeros(len(texts), bool)
                    mask[list(changed)] = True
                    cols[sized] = pc.if_else(pa.array(mask), pc.utf8_length(cols[place]).cast(cols[sized].type), cols[sized])
                batch = pa.record_batch(cols, schema=batch.schema)
                batch = batch.filter(pa.array([changed.get(i, "") is not None for i in range(len(texts))]))
            yield batch

    return common.mapped(docs, run, docs.schema)


def _decontaminate_by_sets(docs: DataFrame, sets: list[DataFrame], remove: str, gap: int) -> DataFrame:
    """The same for a benchmark of several sets: the windows of all sets, then one cut, until no set finds any."""
    todo = common.project(docs).select(F.col("doc_id").alias("o_id"), common.text_key(F.col("text")).alias("o_key"), "text")
    rounds: list[DataFrame] = []  # what became of documents in each round, the later round holding

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.pieces(batches):
            texts = []
            for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist()):
                mine = _spans([(0, s["item_id"], s["a"], s["b"]) for s in spans], gap).get(0, [])
                texts.append(None if remove == "documents" else _cut(text, mine))
            yield pa.record_batch([batch.column("o_id"), batch.column("o_key"), pa.array(texts, pa.string())], names=["o_id", "o_key", "text"])

    while True:
        spans = common.materialize(_windows(todo, sets).groupBy(F.col("o_id").alias("w_id"), F.col("o_key").alias("w_key")).agg(F.collect_list(F.struct("item_id", "a", "b")).alias("spans")), "spans")
        if spans.isEmpty():
            break
        hit = todo.join(spans, F.col("o_id").eqNullSafe(F.col("w_id")) & (F.col("o_key") == F.col("w_key"))).dropDuplicates(["o_id", "o_key"]).select("o_id", "o_key", "text", "spans")
        rounds.append(common.materialize(common.mapped(hit, cut, "o_id bigint, o_key bigint, text string"), "cut"))
        if remove == "documents":
            break
        todo = rounds[-1]
    if not rounds:
        return docs
    last = rounds[0].select("*", F.lit(0).alias("turn"))
    for k, more in enumerate(rounds[1:], 1):
        last = last.union(more.select("*", F.lit(k)))
    last = last.groupBy("o_id", "o_key").agg(F.max_by(F.struct("text"), "turn").alias("now"))
    doc, key, now = common.fresh(docs, "c_doc", "c_key", "c_now")
    out = docs.join(last.toDF(doc, key, now), docs["doc_id"].cast("bigint").eqNullSafe(F.col(doc)) & (common.text_key(F.coalesce(F.col("text").cast("string"), F.lit(""))) == F.col(key)), "left")
    kept = out.where(F.col(now).isNull() | (F.trim(F.coalesce(F.col(now)["text"], F.lit(""))) != ""))
    cols = []
    for name in docs.columns:
        old = F.col(f"`{name}`")
        if name == "text":
            cols.append(F.when(F.col(now).isNull(), old).otherwise(F.col(now)["text"]).alias("text"))
        elif name == "n_chars":
            cols.append(F.when(F.col(now).isNull(), old).otherwise(F.length(F.col(now)["text"])).cast(docs.schema["n_chars"].dataType).alias("n_chars"))
        else:
            cols.append(old)
    return kept.select(*cols)


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_contamination(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))


_SPLIT = "list_filter(list_transform(regexp_split_to_array(lower(coalesce(text, '')), '[\\s\\x0b\\x1c-\\x1f\\x{85}\\p{Z}]+'), lambda x: regexp_replace(x, '[^\\p{L}\\p{N}]', '', 'g')), lambda x: x <> '')"
ORACLE = f"""
WITH b AS (SELECT item_id, {_SPLIT} AS w FROM benchmark),
grams AS (SELECT DISTINCT item_id, least(len(w), {N}) AS k, list_aggregate(w[i:i + least(len(w), {N}) - 1], 'string_agg', ' ') AS g
          FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - {N} + 1, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
d AS (SELECT doc_id, {_SPLIT} AS w FROM documents),
sizes AS (SELECT DISTINCT k FROM grams),
wins AS (SELECT doc_id, k, i, list_aggregate(w[i:i + k - 1], 'string_agg', ' ') AS g
         FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, sizes WHERE len(w) >= k)),
hits AS (SELECT doc_id, item_id, i - 1 AS a, i - 1 + k AS e FROM wins JOIN grams USING (k, g)),
marked AS (SELECT *, CASE WHEN a <= max(e) OVER (PARTITION BY doc_id, item_id ORDER BY a, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + {GAP} THEN 0 ELSE 1 END AS fresh FROM hits),
islands AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id, item_id ORDER BY a, e) AS island FROM marked)
SELECT doc_id, item_id, min(a)::INT AS first_word, (max(e) - 1)::INT AS last_word, (max(e) - min(a))::INT AS n_words
FROM islands GROUP BY doc_id, item_id, island
"""
