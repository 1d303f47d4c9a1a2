"""9. Token counts: a table of exact counts at every prefix, by prefix dynamic programming."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession

from . import common, tokenizer

BUDGETS = (128, 512, 2048)


def unpack(packed: bytes) -> np.ndarray:
    """Token counts of text[:p] for p = 0 .. n_chars."""
    raw = zstandard.ZstdDecompressor().decompress(packed) if packed else b""
    return np.concatenate([[0], np.cumsum(np.frombuffer(raw, np.int8), dtype=np.int64)])


def count_at(packed: bytes, chars: int) -> int:
    """Tokens of the prefix of ``chars`` characters, without encoding anything."""
    return int(unpack(packed)[chars])


def truncate_at(packed: bytes, budget: int) -> int:
    """Characters of the longest prefix of at most ``budget`` tokens."""
    return int(np.flatnonzero(unpack(packed) <= budget)[-1])


def prefix_counts(docs: DataFrame, budgets: tuple[int, ...] = BUDGETS, vocab: str = tokenizer.DEFAULT_VOCAB) -> DataFrame:
    """For every document the exact token count of each of its prefixes, and answers from it.

    ``n_tokens`` is the count of the whole text, ``fit_B`` the characters of the longest prefix of at most
    B tokens (a longer prefix can have fewer tokens than a shorter one), ``prefix_table`` the compressed
    table for :func:`count_at` and :func:`truncate_at`. Characters are code points. No shuffle.

    Nulls: a null text counts as empty: no tokens, an empty table, 0 characters fit. A null doc_id is kept;
    repeated rows give repeated results. An empty table gives no rows. A very long text costs about ten times its own
    size in memory; others are taken together up to four times ``common.PIECE`` bytes.
    """
    names = ["doc_id", "n_chars", "n_tokens", *(f"fit_{b}" for b in budgets), "prefix_table"]
    schema = "doc_id bigint, n_chars bigint, n_tokens bigint, " + "".join(f"fit_{b} bigint, " for b in budgets) + "prefix_table binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, pack = tokenizer.prefix_table(vocab), zstandard.ZstdCompressor(level=1)
        for batch in common.pieces(batches, size=4 * common.PIECE):
            chars, total, fits, tables = [], [], [], []
            for raw in made.deltas(batch.column("text")):
                counts = np.cumsum(np.frombuffer(raw, np.int8), dtype=np.int32)
                chars.append(len(counts))
                total.append(int(counts[-1]) if len(counts) else 0)
                row = []
                for b in budgets:
                    if not len(counts) or counts[-1] <= b:
                        row.append(len(counts))
                    else:
                        row.append(int(len(counts) - np.argmax(counts[::-1] <= b)) if (counts <= b).any() else 0)
                fits.append(row)
                tables.append(pack.compress(raw) if raw else b"")
            cols = [batch.column("doc_id"), pa.array(chars, pa.int64()), pa.array(total, pa.int64())]
            cols += [pa.array([f[i] for f in fits], pa.int64()) for i in range(len(budgets))]
            yield pa.record_batch([*cols, pa.array(tables, pa.binary())], names=names)

    return common.mapped(common.project(docs), run, schema)


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_counts(common.table(spark, sf_dir, "documents"))
