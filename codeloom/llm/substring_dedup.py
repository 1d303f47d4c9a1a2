"""7. Substring dedup: a compressed FM-index per shard, matching statistics by backward search."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Words of the shortest passage that is reported.
MIN_WORDS = 50
#: Words of an anchor. Every passage of MIN_WORDS words contains one that any copy of it contains too.
ANCHOR = 16
#: Words that a shard's index holds at about most.
SHARD_WORDS = 2_000_000


def _sliding(x: np.ndarray, n: int, pick) -> np.ndarray:
    """``pick`` (minimum or maximum) over each run of ``n`` neighbours, by doubling."""
    have, out = 1, x
    while have * 2 <= n:
        out = pick(out[: len(out) - have], out[have:])
        have *= 2
    if have < n:
        out = pick(out[: len(out) - (n - have)], out[n - have :])
    return out


def anchors(h: np.ndarray, bounds: np.ndarray, least: int = MIN_WORDS, size: int = ANCHOR) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the anchors: n-grams that are least in some window of ``least`` words of a row."""
    span = least - size + 1
    ok = common.window_ok(bounds, least)  # windows of ``least`` words
    if not ok.any():
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    g = common.ngram_hashes(h, size)
    low = np.where(ok, _sliding(g, span, np.minimum)[: len(ok)], np.uint64(0))
    pad = np.zeros(span - 1, np.uint64)
    top = _sliding(np.concatenate([pad, low, pad]), span, np.maximum)  # over the windows that hold each n-gram
    at = np.flatnonzero((g == top[: len(g)]) & (top[: len(g)] > 0))
    return at, g[at]


class FMIndex:
    """Backward search over a text of integers in which 0 separates pieces.

    The Burrows-Wheeler transform is kept as a wavelet matrix: one bit vector for each bit of a symbol's rank in the
    shard's alphabet, packed in 64-bit words; the ones before a word are counted from the last of every ``SUPER`` words
    in 16 bits. That is a bit and a quarter for each bit of a symbol, less than the text of hashes takes. Neither the
    text nor the order of the suffixes is kept: of the order only the document of each run of suffixes (:meth:`owned`).
    Suffixes are sorted to a depth of ``depth`` symbols, which is exact for patterns up to that length. All searches run
    on many patterns at once.
    """

    SUPER = 1 << 10

    def __init__(self, text: np.ndarray, depth: int, owner: np.ndarray) -> None:
        self.symbols, codes = np.unique(text, return_inverse=True)
        self.n = len(codes)
        rank, have = codes.astype(np.int64), 1
        order = np.argsort(rank, kind="stable")
        while have < depth:
            after = np.zeros(self.n, np.int64)
            after[: self.n - have] = rank[have:] + 1
            key = rank * (self.n + 1) + after
            order = np.argsort(key, kind="stable")
            k = key[order]
            step = np.empty(self.n, np.int64)
            step[0] = 0
            np.cumsum(k[1:] != k[:-1], out=step[1:])
            rank = np.empty(self.n, np.int64)
            rank[order] = step
            have *= 2
            if step[-1] == self.n - 1:
                break
        sorted_owner = owner[order].astype(np.int32)
        self.run_end = (np.flatnonzero(np.concatenate([sorted_owner[1:] != sorted_owner[:-1], [True]])) + 1).astype(np.int32)
        self.run_owner = sorted_owner[self.run_end - 1]
        self.first = np.concatenate([[0], np.cumsum(np.bincount(codes, minlength=len(self.symbols)))])
        self._wavelet(codes[order - 1])

    def _wavelet(self, bwt: np.ndarray) -> None:
        self.levels = max(1, int(len(self.symbols) - 1).bit_length())
        self.bits, self.counts, self.zeros = [], [], []
        here = bwt.astype(np.uint32)
        starts = np.zeros(len(self.symbols), np.int64)
        codes = np.arange(len(self.symbols))
        for level in range(self.levels - 1, -1, -1):
            bit = (here >> np.uint32(level) & np.uint32(1)).astype(bool)
            packed = np.packbits(bit, bitorder="little")
            words = np.zeros(self.n // 64 + 1, np.uint64)
            words.view(np.uint8)[: len(packed)] = packed
            self.bits.append(words)
            before = np.cumsum(np.bitwise_count(words), dtype=np.int64) - np.bitwise_count(words)
            top = before[:: self.SUPER]
            self.counts.append((top, (before - np.repeat(top, self.SUPER)[: len(before)]).astype(np.uint16)))
            self.zeros.append(self.n - int(bit.sum()))
            one = (codes >> level & 1).astype(bool)
            ones = self._ones(len(self.bits) - 1, starts)
            starts = np.where(one, self.zeros[-1] + ones, starts - ones)
            here = np.concatenate([here[~bit], here[bit]])
        self.starts = starts  # where a symbol's run begins below the last level

    def _ones(self, level: int, at: np.ndarray) -> np.ndarray:
        word = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        top, count = self.counts[level]
        return top[word // self.SUPER] + count[word] + np.bitwise_count(self.bits[level][word] & mask)

    def owned(self, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The document of the suffix at each place of the order, and where the run of suffixes of that document ends."""
        run = np.minimum(np.searchsorted(self.run_end, lo, side="right"), len(self.run_end) - 1)
        return self.run_owner[run], self.run_end[run]

    def step(self, code: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of the patterns with ``code`` put before them."""
        m = len(code)
        at = np.concatenate([lo, hi])
        twice = np.concatenate([code, code])
        for i in range(self.levels):
            one = (twice >> (self.levels - 1 - i) & 1).astype(bool)
            ones = self._ones(i, at)
            at = np.where(one, self.zeros[i] + ones, at - ones)
        base = self.first[code] - self.starts[code]
        return base + at[:m], base + at[m:]


def covered(pieces: list[np.ndarray], marks: np.ndarray, docs: np.ndarray, least: int = MIN_WORDS, size: int = ANCHOR) -> list[tuple[int, int, int]]:
    """(piece, begin, end) of the stretches made of ``least``-word windows over the anchor that another document has.

    ``pieces`` are distinct; ``marks`` is where each one's anchor begins; ``docs`` the code of the one document
    that has the piece, or -1 for several. A piece of several documents is returned whole. The others stream past the
    index: for an end in a piece, backward search gives its matching statistic, how far to the left another document
    has the text that ends there. The furthest end of a match that begins at the anchor is bisected; from there the
    statistics of ends are taken to the left, as far as a window can hold the anchor, and those of ``least`` words or
    more are reported. After a hit of n words, the next end that can add a window is asked; the ones between lie in it.
    """
    sizes = np.asarray([len(p) for p in pieces])
    out = [(i, 0, int(sizes[i])) for i in np.flatnonzero(docs < 0)]
    ask = np.flatnonzero((docs >= 0) & (sizes >= least))
    if len(ask) and len(pieces) > 1:
        text = np.zeros(int(sizes.sum()) + len(pieces), np.uint64)
        begins = np.cumsum(sizes + 1) - sizes - 1
        text[common.ragged(begins, sizes)] = np.concatenate(pieces).astype(np.uint64) + np.uint64(1)
        index = FMIndex(text, int(sizes.max()) + 1, np.repeat(docs, sizes + 1))
        codes = np.searchsorted(index.symbols, text).astype(np.int32)
        del text

        def matched(who: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
            """The least start, not under ``begin``, from which up to ``end`` another document has the text too."""
            at = end.copy()
            lo, hi = np.zeros(len(who), np.int64), np.full(len(who), index.n, np.int64)
            live = np.flatnonzero(at > begin)
            while len(live):
                w = who[live]
                a, b = index.step(codes[begins[w] + at[live] - 1], lo[live], hi[live])
                owner, until = index.owned(a)
                good = (b > a) & ((owner != docs[w]) | (until < b))
                live, a, b = live[good], a[good], b[good]
                lo[live], hi[live] = a, b
                at[live] -= 1
                live = live[at[live] > begin[live]]
            return at

        p = marks[ask]
        low, high = p + size, sizes[ask].copy()  # the anchor itself is known to match
        first = matched(ask, p, high) <= p  # the whole right side at once: the common case
        low = np.where(first, high, low)
        while (open_ := np.flatnonzero(low < high)).size:
            mid = (low[open_] + high[open_] + 1) // 2
            fits = matched(ask[open_], p[open_], mid) <= p[open_]
            low[open_] = np.where(fits, mid, low[open_])
            high[open_] = np.where(fits, high[open_], mid - 1)
        right = low
        left = np.zeros(len(ask), np.int64)
        hope = np.flatnonzero(right >= least)
        left[hope] = matched(ask[hope], np.zeros(len(hope), np.int64), p[hope] + size)
        live = hope[right[hope] - left[hope] >= least]
        end = right.copy()
        # from the right: the longest match that ends at ``end``; then the next end that can add a window
        while len(live):
            begin = matched(ask[live], left[live], end[live])
            hit = end[live] - begin >= least
            out += list(zip(ask[live[hit]].tolist(), begin[hit].tolist(), end[live[hit]].tolist()))
            end[live] = np.where(hit, begin - 1 + least, end[live] - 1)
            live = live[(end[live] - left[live] >= least) & (end[live] >= p[live] + size)]
    return out


def repeated_passages(docs: DataFrame, least: int = MIN_WORDS, anchor: int = ANCHOR, shard_words: int = SHARD_WORDS) -> DataFrame:
    """``doc_id, first_word, last_word, n_words`` of every passage of ``least`` words or more that another document has.

    Words are lower case without marks, counted from 0. A passage is a maximal run of words each of which lies in
    a window of ``least`` words that occurs in another document as well; windows may come from different ones.

    Anchors that several documents share are found by one shuffle; only the words around them go to the shards,
    dealt by the anchor's hash. In a shard equal pieces become one, an FM-index is built over the distinct ones,
    and every piece is searched in it. Exact, but for hash collisions (64 bits an anchor, 32 bits a word).

    Nulls: a null text has no words; a null doc_id is a document like others. Rows that agree in doc_id and text
    are one document, so they do not repeat each other. Shorter texts give nothing; empty tables neither.
    """
    keyed = common.project(docs).withColumn("key", common.text_key(F.col("text"))).withColumn("d", F.xxhash64(F.coalesce("doc_id", F.lit(-1)), F.col("doc_id").isNull(), "key"))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.pieces(batches):
            w = common.normal_words(batch.column("text"))
            if not len(w.codes):
                continue
            at, g = anchors(w.hashes()[w.codes], w.bounds, least, anchor)
            rows = np.searchsorted(w.bounds, at, side="right") - 1
            yield pa.record_batch([pa.array(g.view(np.int64)), batch.column("d").take(pa.array(rows)), pa.array((at - w.bounds[rows]).astype(np.int32))], names=["anchor", "d", "place"])

    found = common.mapped(keyed.select("d", "text"), find, "anchor bigint, d bigint, place int")

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        t = pa.Table.from_batches(held)
        a, d = t.column("anchor").to_numpy(), t.column("d").to_numpy()
        order = np.argsort(a, kind="stable")
        a, d = a[order], d[order]
        cuts = np.flatnonzero(np.r_[True, a[1:] != a[:-1]])
        several = np.minimum.reduceat(d, cuts) != np.maximum.reduceat(d, cuts)
        keep = order[np.repeat(several, np.diff(np.r_[cuts, len(a)]))]
        yield from t.take(pa.array(keep)).combine_chunks().to_batches(max_chunksize=100_000)

    several = common.mapped(found.repartition("anchor"), shared, "anchor bigint, d bigint, place int")
    places = common.materialize(several.distinct().groupBy("d").agg(F.collect_list("place").alias("places"), F.collect_list("anchor").alias("anchors")), "anchors")
    n = places.agg(F.sum(F.size("places"))).first()[0] or 0
    shards = max(12, -(-n * (2 * least - anchor) // shard_words))
    texts = keyed.join(places, "d").select("d", "doc_id", "text", "places", "anchors")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.pieces(batches):
            w = common.normal_words(batch.column("text"))
            flat = (w.hashes() & np.uint64(0xFFFFFFFF)).astype(np.uint32)[w.codes] if len(w.codes) else np.zeros(0, np.uint32)
            lists = batch.column("places")
            at = np.asarray(lists.flatten()).astype(np.int64)
            rows = np.repeat(np.arange(batch.num_rows), np.diff(np.asarray(lists.offsets)))
            size = w.lens[rows]
            begin, end = np.maximum(0, at + anchor - least), np.minimum(size, at + least)
            flat = np.ascontiguousarray(flat[common.ragged(w.starts[rows] + begin, end - begin)])
            off = np.concatenate([[0], np.cumsum((end - begin) * 4)])
            step = 200_000
            name = np.asarray(batch.column("anchors").flatten())
            for k in range(0, len(at), step):
                sl = slice(k, k + step)
                here = off[k : k + step + 1]
                raw = flat[here[0] // 4 : here[-1] // 4].tobytes()
                words = pa.Array.from_buffers(pa.binary(), len(here) - 1, [None, pa.py_buffer((here - here[0]).astype(np.int32)), pa.py_buffer(raw)])
                take = pa.array(rows[sl])
                yield pa.record_batch(
                    [pa.array((common.mix(name[sl].view(np.uint64), 3) % np.uint64(shards)).astype(np.int32)), batch.column("d").take(take), batch.column("doc_id").take(take), pa.array(begin[sl].astype(np.int32)), pa.array((at[sl] - begin[sl]).astype(np.int32)), words],
                    names=["shard", "d", "doc_id", "begin", "mark", "words"],
                )

    pieces = common.mapped(texts, cut, "shard int, d bigint, doc_id bigint, begin int, mark int, words binary")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in common.groups(batches, "shard"):
            t = t.combine_chunks()
            raw, d, mark = t.column("words").to_pylist(), t.column("d").to_numpy(), t.column("mark").to_numpy()
            seen: dict[tuple, int] = {}
            kind = np.fromiter((seen.setdefault(k, len(seen)) for k in zip(raw, mark.tolist())), np.int64, len(raw))
            _, codes = np.unique(d, return_inverse=True)
            low, high = np.full(len(seen), np.iinfo(np.int64).max), np.full(len(seen), -1)
            np.minimum.at(low, kind, codes)
            np.maximum.at(high, kind, codes)
            distinct = [np.frombuffer(r, np.uint32) for r, _ in seen]
            marks = np.asarray([m for _, m in seen], np.int64)
            hits = np.asarray(covered(distinct, marks, np.where(low == high, low, -1), least, anchor), np.int64).reshape(-1, 3)
            # back from distinct pieces to all their places
            order = np.argsort(kind, kind="stable")
            start = np.searchsorted(kind[order], hits[:, 0])
            many = np.searchsorted(kind[order], hits[:, 0], side="right") - start
            rows = order[common.ragged(start, many)]
            begin = t.column("begin").to_numpy()[rows]
            a, b = begin + np.repeat(hits[:, 1], many), begin + np.repeat(hits[:, 2], many)
            ok = b - a >= least
            take = pa.array(rows[ok])
            yield pa.record_batch([pa.array(d[rows[ok]]), t.column("doc_id").combine_chunks().take(take) if t.num_rows else pa.array([], pa.int64()), pa.array(a[ok].astype(np.int32)), pa.array(b[ok].astype(np.int32))], names=["d", "doc_id", "a", "b"])

    hits = common.mapped(pieces.repartition("shard").sortWithinPartitions("shard"), search, "d bigint, doc_id bigint, a int, b int").distinct()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in common.groups(batches, "d"):
            a, b = t.column("a").to_numpy(), t.column("b").to_numpy()
            top = np.maximum.accumulate(b)
            new = np.r_[True, a[1:] > top[:-1]]
            first = np.flatnonzero(new)
            last = np.r_[first[1:] - 1, len(a) - 1]
            doc = t.column("doc_id")[0].as_py()
            yield pa.record_batch([pa.array([doc] * len(first), pa.int64()), pa.array(a[first]), pa.array((top[last] - 1).astype(np.int32)), pa.array((top[last] - a[first]).astype(np.int32))], names=["doc_id", "first_word", "last_word", "n_words"])

    return common.mapped(hits.repartition("d").sortWithinPartitions("d", "a"), merge, "doc_id bigint, first_word int, last_word int, n_words int")


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(common.table(spark, sf_dir, "documents"))


ORACLE = f"""
WITH d AS (SELECT DISTINCT doc_id, text, list_filter(list_transform(regexp_split_to_array(lower(coalesce(text, '')), '[\\s\\x0b\\x1c-\\x1f\\x{{85}}\\p{{Z}}]+'), lambda x: regexp_replace(x, '[^\\p{{L}}\\p{{N}}]', '', 'g')), lambda x: x <> '') AS w FROM documents),
wins AS (SELECT doc_id, text, i, md5(list_aggregate(w[i:i + {MIN_WORDS - 1}], 'string_agg', ' ')) AS g FROM (SELECT doc_id, text, w, unnest(range(1, len(w) - {MIN_WORDS - 2})) AS i FROM d WHERE len(w) >= {MIN_WORDS})),
several AS (SELECT g FROM wins GROUP BY g HAVING count(DISTINCT (doc_id, md5(text))) > 1),
hits AS (SELECT doc_id, text, i FROM wins WHERE g IN (SELECT g FROM several)),
marked AS (SELECT *, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id, text ORDER BY i) <= {MIN_WORDS} THEN 0 ELSE 1 END AS fresh FROM hits),
islands AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id, text ORDER BY i) AS island FROM marked)
SELECT doc_id, (min(i) - 1)::INT AS first_word, (max(i) + {MIN_WORDS - 2})::INT AS last_word, (max(i) - min(i) + {MIN_WORDS})::INT AS n_words FROM islands GROUP BY doc_id, text, island
"""
