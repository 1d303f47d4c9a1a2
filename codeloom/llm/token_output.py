"""1. Token-ID / binary output: Arrow IPC files of fixed-size-list batches, read without copying."""

from __future__ import annotations

import functools
import uuid
from collections.abc import Iterator
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from . import common, tokenizer

SEQ_LEN = 2048
ROWS_PER_BATCH = 256
EOS = 50256
#: Folder of the table of files, below the one that they are in.
MANIFEST = "_files"
SCHEMA = "doc_id bigint, file string, first_sequence bigint, first_offset int, n_tokens bigint"


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri) if urlparse(uri).scheme else (pafs.LocalFileSystem(), uri)


def _schema(kind: np.dtype, seq_len: int) -> pa.Schema:
    return pa.schema([("input_ids", pa.list_(pa.from_numpy_dtype(kind), seq_len)), ("mask", pa.list_(pa.uint8(), seq_len))])


class _Writer:
    """Cuts the token stream of one task into sequences, and these into batches of equal size."""

    def __init__(self, uri: str, kind: np.dtype, seq_len: int, per_batch: int, eos: int) -> None:
        self.fs, self.path = _open(uri)
        self.fs.create_dir(self.path.rpartition("/")[0], recursive=True)
        self.seq_len, self.per_batch, self.eos = seq_len, per_batch, eos
        self.schema = _schema(kind, seq_len)
        self.sink = self.fs.open_output_stream(self.path)
        self.out = pa.ipc.new_file(self.sink, self.schema)
        self.held, self.n_held, self.kind = [], 0, kind

    def add(self, tokens: np.ndarray) -> None:
        self.held.append(tokens)
        self.n_held += len(tokens)
        block = self.seq_len * self.per_batch
        if self.n_held >= block:
            flat = np.concatenate(self.held)
            whole = len(flat) // block * block
            for at in range(0, whole, block):
                self._batch(flat[at : at + block], block)
            self.held, self.n_held = [flat[whole:]], len(flat) - whole

    def _batch(self, flat: np.ndarray, real: int) -> None:
        mask = pa.array((np.arange(len(flat)) < real).view(np.uint8))
        lists = [pa.FixedSizeListArray.from_arrays(pa.array(flat), self.seq_len), pa.FixedSizeListArray.from_arrays(mask, self.seq_len)]
        self.out.write_batch(pa.record_batch(lists, schema=self.schema))

    def close(self) -> None:
        if self.n_held:
            flat = np.concatenate(self.held)
            pad = -len(flat) % self.seq_len
            self._batch(np.concatenate([flat, np.full(pad, self.eos, self.kind)]), len(flat))
        self.out.close()
        self.sink.close()


def write_sequences(docs: DataFrame, folder: str, seq_len: int = SEQ_LEN, vocab: str = tokenizer.DEFAULT_VOCAB, eos: int = EOS, per_batch: int = ROWS_PER_BATCH) -> DataFrame:
    """Tokenise every document into Arrow IPC files below ``folder``; return where each document begins.

    Each task writes one file: its documents' tokens, each followed by ``eos``, cut into sequences of
    ``seq_len`` ids (``input_ids``) with ``mask`` 1 where an id is real, a byte each, so that both are read without a
    copy. Only the last sequence of a file is padded. Every batch but a file's last has ``per_batch`` sequences, so
    sequence ``i`` is row ``i % per_batch`` of batch ``i // per_batch``. No shuffle. A task that is repeated leaves the
    file of its lost attempt behind: :func:`files_of` has those that count, as the written result names them.

    Nulls: a null or empty text writes nothing, ``n_tokens`` 0 and null places; a null doc_id is kept.
    Repeated rows are written as often as they occur. An empty table gives no rows and no files. A very long text
    costs its own size in memory; others are taken together up to ``common.PIECE`` bytes.
    """
    folder = folder.rstrip("/")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, kind = tokenizer.coder(vocab)
        if eos > np.iinfo(kind).max:
            kind = np.dtype(np.uint32)
        here = TaskContext.get()
        uri = f"{folder}/part-{here.partitionId():06d}-{here.taskAttemptId()}-{uuid.uuid4().hex[:8]}.arrow"
        writer, at = None, 0
        for batch in common.pieces(batches):
            ids, bounds = tokenizer.token_ids(batch.column("text"), vocab)
            lens = np.diff(bounds)
            if writer is None and len(ids):
                writer = _Writer(uri, kind, seq_len, per_batch, eos)
            full = lens > 0
            if len(ids):
                stream = np.insert(ids.astype(kind, copy=False), bounds[1:][full], np.array(eos, kind))
                writer.add(stream)
            sizes = lens + full
            begin = at + np.cumsum(sizes) - sizes
            at += int(sizes.sum())
            gone = ~full
            yield pa.record_batch(
                [
                    batch.column("doc_id"),
                    pa.array(np.where(full, uri, None), pa.string()),
                    pa.array(begin // seq_len, pa.int64(), mask=gone),
                    pa.array((begin % seq_len).astype(np.int32), pa.int32(), mask=gone),
                    pa.array(lens, pa.int64()),
                ],
                names=["doc_id", "file", "first_sequence", "first_offset", "n_tokens"],
            )
        if writer is not None:
            writer.close()

    rows = common.materialize(common.mapped(common.project(docs), run, SCHEMA), "sequence-rows")
    rows.where("file IS NOT NULL").select("file").distinct().write.mode("overwrite").parquet(f"{folder}/{MANIFEST}")
    return rows


def files_of(spark: SparkSession, folder: str) -> DataFrame:
    """``file``: the files below ``folder`` that hold its sequences, each once."""
    return spark.read.schema("file string").parquet(f"{folder.rstrip('/')}/{MANIFEST}")


class Sequences:
    """Random access to one file through a memory map: ``seqs[i]`` is (ids, mask), both views of the file."""

    def __init__(self, path: str) -> None:
        self.reader = pa.ipc.open_file(pa.memory_map(urlparse(path).path if "://" in path or path.startswith("file:") else path))
        n = self.reader.num_record_batches
        self.per_batch = self.reader.get_batch(0).num_rows if n else 1
        self.n = (n - 1) * self.per_batch + self.reader.get_batch(n - 1).num_rows if n else 0
        self.seq_len = self.reader.schema.field("input_ids").type.list_size
        self._batch = functools.lru_cache(8)(self.reader.get_batch)

    def __len__(self) -> int:
        return self.n

    def __getitem__(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        if not 0 <= i < self.n:
            raise IndexError(i)
        batch, row = self._batch(i // self.per_batch), i % self.per_batch
        lo, hi = row * self.seq_len, (row + 1) * self.seq_len
        return batch.column(0).values[lo:hi].to_numpy(zero_copy_only=True), batch.column(1).values[lo:hi].to_numpy(zero_copy_only=True)

    def document(self, first_sequence: int, first_offset: int, n_tokens: int) -> list[int]:
        out, at, skip = [], first_sequence, first_offset
        while len(out) < n_tokens:
            out += self[at][0][skip : skip + n_tokens - len(out)].tolist()
            at, skip = at + 1, 0
        return out


def op1_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{common.shared_dir(spark)}/codeloom/sequences-{uuid.uuid4().hex}"
    common._drop_at_exit(spark, folder)
    return write_sequences(common.table(spark, sf_dir, "documents"), folder)
