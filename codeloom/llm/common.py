"""What the operators share: input projection, materialised tables, vectorised words, batch helpers.

Every operator projects its input to ``doc_id`` (bigint) and ``text`` first, so other columns of
any name cannot clash with internal ones.  A null text counts as the empty text.
"""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
GOLDEN = U64(0x9E3779B97F4A7C15)
#: Bytes of text that are worked on at a time, and words that a worker remembers (speed and memory only).
PIECE = 1 << 20
REMEMBERED = 100_000
_MARKS = r"[^\p{L}\p{N}]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def project(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and ``text`` alone; null texts become empty."""
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that ``df`` has not got, whatever its case rules."""
    have = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in have:
            name += "_"
        have.add(name.lower())
        out.append(name)
    return out


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share; one of our own only where the session names none."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="codeloom-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def delete_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    if jvm is not None:
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def _drop_at_exit(spark: SparkSession, path: str) -> None:
    def drop() -> None:
        try:
            if spark.sparkContext._jsc is not None and not spark.sparkContext._jsc.sc().isStopped():
                delete_path(spark, path)
        except Exception:  # the gateway is gone: nothing left to clean with
            return

    atexit.register(drop)


def materialize(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """``df`` written once as Parquet below the shared folder and read again: lineage ends here.

    ``by`` is its last column if each of its values is to have a folder of its own. Survives the loss of any executor. The folder goes when the driver's Python ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/codeloom/{name}-{uuid.uuid4().hex}"
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    _drop_at_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def frees_shuffles(spark: SparkSession) -> Iterator[None]:
    """Within it, shuffle files go where the write or action that made them ends, not when the driver happens to collect its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before) if before is not None else spark.conf.unset(name)


def text_key(text: Column) -> Column:
    """Second half of a document row's identity: rows equal in doc_id and text are one document."""
    return F.xxhash64(text)


def mix(h: np.ndarray, salt: int = 0) -> np.ndarray:
    """splitmix64 finaliser, vectorised."""
    with np.errstate(over="ignore"):
        z = h + U64((salt * 0x9E3779B97F4A7C15 + 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
        z = (z ^ (z >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> U64(27))) * U64(0x94D049BB133111EB)
        return z ^ (z >> U64(31))


_BYTE = mix(np.arange(256, dtype=np.uint64), 11)
_PLACE = mix(np.arange(1 << 12, dtype=np.uint64), 13) | U64(1)


def string_hashes(s: pa.Array) -> np.ndarray:
    """A 64-bit hash of each string (large strings): a sum over its bytes of random numbers by byte times place."""
    if not len(s):
        return np.zeros(0, U64)
    off = np.frombuffer(s.buffers()[1], np.int64, len(s) + 1, s.offset * 8)
    lens = np.diff(off)
    place = ragged(np.zeros(len(s), np.int64), lens)
    by = _PLACE[place] if lens.max() <= len(_PLACE) else mix(place.astype(np.uint64), 13) | U64(1)
    run = np.zeros(len(place) + 1, np.uint64)
    if len(place):
        with np.errstate(over="ignore"):
            np.cumsum(_BYTE[np.frombuffer(s.buffers()[2], np.uint8, len(place), off[0])] * by, out=run[1:])
    off = off - off[0]
    return mix((run[off[1:]] - run[off[:-1]]) ^ lens.astype(np.uint64))


class Words:
    """The words of a batch of texts: a small vocabulary, and a code for each word in order.

    ``codes`` are positions in ``dictionary`` (large strings; ``vocab`` has them as a list of str); ``bounds`` has the
    slice of each row. Splitting, encoding, normalising and hashing run in Arrow's and numpy's kernels.
    """

    def __init__(self, text: pa.Array, lower: bool = True) -> None:
        text = text.cast(pa.large_string())
        if lower:
            text = pc.utf8_lower(text)
        parts = pc.utf8_split_whitespace(text)
        offsets = np.asarray(parts.offsets)
        flat = pc.dictionary_encode(parts.values.slice(offsets[0], offsets[-1] - offsets[0]))
        self.dictionary = flat.dictionary
        self.codes = np.asarray(flat.indices)
        self.bounds = (offsets - offsets[0]).astype(np.int64)
        self._drop_empty()  # leading and trailing space leaves empty words

    def _drop_empty(self) -> None:
        gone = pc.binary_length(self.dictionary).to_numpy(zero_copy_only=False) == 0
        if gone.any():
            keep = ~gone[self.codes]
            self.bounds = np.concatenate([[0], np.cumsum(keep)])[self.bounds]
            self.codes = self.codes[keep]

    def normalise(self) -> None:
        """Take all but letters and numbers out of the words; what is empty then is no word."""
        odd = np.flatnonzero(~pc.utf8_is_alnum(self.dictionary).to_numpy(zero_copy_only=False))
        if len(odd):
            forms = pc.replace_substring_regex(self.dictionary.take(pa.array(odd)), _MARKS, "")
            place = np.arange(len(self.dictionary))
            place[odd] = len(place) + np.arange(len(odd))
            self.dictionary = pa.concat_arrays([self.dictionary, forms]).take(pa.array(place))
            self._drop_empty()

    @property
    def vocab(self) -> list[str]:
        return self.dictionary.to_pylist()

    def phrase(self, begin: int, end: int) -> str:
        """The words from one place to another, a space between."""
        return " ".join(self.dictionary[int(c)].as_py() for c in self.codes[begin:end])

    @property
    def starts(self) -> np.ndarray:
        return self.bounds[:-1]

    @property
    def lens(self) -> np.ndarray:
        return np.diff(self.bounds)

    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bounds) - 1), self.lens)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash for each entry of the vocabulary."""
        return string_hashes(self.dictionary)


def normal_words(text: pa.Array) -> Words:
    """Words in lower case without marks; words of marks alone are no words."""
    w = Words(text)
    w.normalise()
    return w


def rest() -> None:
    """Give memory that a task no longer uses back to the system: idle workers stay beside those of the next stage."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        return


_remembered: list[Callable[[], None]] = []
_busy_with = ""


def remembers(forget: Callable[[], None]) -> None:
    """Names what empties something that a worker keeps from one task to the next."""
    _remembered.append(forget)


def takes_over(operator: str) -> None:
    """Called where a task begins: what its worker remembers of another operator's tasks goes."""
    global _busy_with
    if operator != _busy_with:
        for forget in _remembered:
            forget()
        _busy_with = operator
        rest()


def give_back(spark: SparkSession) -> int:
    """Have executors collect their garbage, after which their JVMs return heap that they no longer use; the number of tasks that did.

    A heap that a stage has grown otherwise stays at its size beside the Python workers of the next.
    """
    n = spark.sparkContext.defaultParallelism
    return len(spark.range(0, n, 1, n).select(F.java_method(F.lit("java.lang.System"), F.lit("gc"))).collect())


def mapped(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``df.mapInArrow``, before and after which the worker's memory is tidied."""
    operator = run.__module__

    def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        takes_over(operator)
        yield from run(batches)
        rest()

    return df.mapInArrow(tidy, schema)


def in_pieces(text: pa.Array, of: Callable[[pa.Array], pa.Array]) -> pa.Array:
    """``of`` the texts of a batch, taken in pieces of about :data:`PIECE` bytes."""
    made = [of(b.column(0)) for b in pieces(iter([pa.record_batch([text], names=["text"])]))]
    return pa.concat_arrays(made) if made else of(text)


def pieces(batches: Iterator[pa.RecordBatch], column: str = "text", size: int = PIECE, rows: int = 60_000) -> Iterator[pa.RecordBatch]:
    """The batches, cut where their texts have come to about ``size`` bytes; a longer text is whole all the same."""
    for batch in batches:
        if not batch.num_rows:
            continue
        total = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        share = total // size
        starts = np.flatnonzero(np.r_[True, share[1:] != share[:-1]])
        for a, b in zip(starts.tolist(), [*starts[1:].tolist(), batch.num_rows]):
            for at in range(a, b, rows):
                yield batch.slice(at, min(rows, b - at))


def ngram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Polynomial hash of the ``n`` words that begin at each place (row bounds are the caller's)."""
    if len(h) < n:
        return np.zeros(0, U64)
    out = np.zeros(len(h) - n + 1, U64)
    with np.errstate(over="ignore"):
        for i in range(n):
            out = out * GOLDEN + h[i : len(h) - n + 1 + i]
    return mix(out)


def window_ok(bounds: np.ndarray, n: int) -> np.ndarray:
    """For each place, whether ``n`` words from it stay in its row; as long as ``ngram_hashes``."""
    total = int(bounds[-1])
    if total < n:
        return np.zeros(0, bool)
    ok = np.ones(total, bool)
    for back in range(1, n):
        at = bounds[1:] - back
        ok[at[at >= bounds[:-1]]] = False
    return ok[: total - n + 1]


def sequence_hash(h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each slice's sequence of hashes."""
    lens = np.diff(bounds)
    place = ragged(np.zeros(len(lens), np.int64), lens).astype(np.uint64)
    with np.errstate(over="ignore"):
        each = mix(h + mix(place) * GOLDEN)
        run = np.concatenate([[np.uint64(0)], np.cumsum(each, dtype=np.uint64)])
        return mix((run[bounds[1:]] - run[bounds[:-1]]) ^ lens.astype(np.uint64))


def ragged(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Indices of the concatenated slices ``[start, start + len)``."""
    total = int(lens.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lens)
    return np.arange(total) - np.repeat(ends - lens - starts, lens)


def groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables of equal ``key`` from batches that are sorted by it. One group is in memory at a time."""
    held: list[pa.Table] = []
    for batch in batches:
        t = pa.Table.from_batches([batch])
        if not t.num_rows:
            continue
        k = t.column(key).combine_chunks()
        k = np.asarray(k.chunk(0) if isinstance(k, pa.ChunkedArray) else k)
        cuts = np.concatenate([[0], np.flatnonzero(k[1:] != k[:-1]) + 1, [len(k)]])
        for a, b in zip(cuts[:-1], cuts[1:]):
            if held and held[0].column(key)[0].as_py() != int(k[a]):
                yield pa.concat_tables(held)
                held = []
            held.append(t.slice(int(a), int(b - a)))
    if held:
        yield pa.concat_tables(held)


def small(df: DataFrame, row_bytes: int, limit: int = 64 << 20) -> DataFrame:
    """``df`` marked for broadcast if its rows, of ``row_bytes`` at most, come to ``limit`` bytes; else to be shuffled.

    The count stops as soon as the limit is passed.
    """
    most = limit // row_bytes
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df
