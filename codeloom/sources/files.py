"""Files of a project as a DataFrame: ``path`` (relative), ``content`` (null for binary files)."""

from __future__ import annotations

import fnmatch
import os
import re
import subprocess
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom import tables
from codeloom.sources import ignore


def text_of(content):
    """Bytes as text: UTF-8, else Latin-1; null where a zero byte tells of binary data."""
    plain = F.try_validate_utf8(content.cast("string"))
    return F.when(~F.contains(content, F.lit(b"\x00")), F.coalesce(plain, F.decode(content, "ISO-8859-1")))


def read_files(spark: SparkSession, root: str, rules: list[tuple[str, bool]] | None = None, suffix: str = "*") -> DataFrame:
    """All files below ``root`` but those in cache folders and those that ``rules`` ignore.

    Paths are tested and dropped before contents are read: the filter uses the path alone. Spark's scan leaves out
    files of no bytes and hidden ones (``.env``, ``__init__.py``); these are listed on the driver and read by name.
    """
    base = root.rstrip("/")
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", suffix).load(base)
    uri = base if "://" in base else "file:" + os.path.abspath(base)
    path = F.regexp_replace(F.regexp_replace("path", r"^file:/+", "file:/"), "^" + re.escape(uri.replace("file://", "file:")) + "/", "")
    named = raw.select(path.alias("path"), "content")
    more = [(p,) for p in _left_out(spark, base) if fnmatch.fnmatch(p.rsplit("/", 1)[-1], suffix)]
    files = named.union(spark.createDataFrame(more, "path string").mapInArrow(_contents, "path string, content binary").select(path.alias("path"), "content"))
    cached = F.arrays_overlap(F.split("path", "/"), F.array(*[F.lit(d) for d in tables.CACHE_DIRS]))
    kept = files.where(~cached)
    kept = ignore.keep(kept, rules) if rules else kept
    return kept.select("path", text_of(F.col("content")).alias("content"))


def _scanned(name: str) -> bool:
    """Whether Spark's own scans take a file or folder of that name."""
    return not (name.startswith(".") or name.startswith("_") and "=" not in name or name.endswith("._COPYING_"))


def _left_out(spark: SparkSession, base: str) -> Iterator[str]:
    """Files that Spark's scan leaves out: those without bytes, and those below or of a name with a leading . or _."""
    if "://" not in base or base.startswith("file://"):
        top = base.removeprefix("file://")
        for folder, below, names in os.walk(top):
            below[:] = [d for d in below if d not in tables.CACHE_DIRS]
            hidden = not all(map(_scanned, os.path.relpath(folder, top).split("/"))) if folder != top else False
            for name in names:
                full = os.path.join(folder, name)
                if os.path.isfile(full) and (hidden or not _scanned(name) or not os.path.getsize(full)):
                    yield "file://" + os.path.abspath(full)
        return
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(base)
    every = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listFiles(target, True)
    while every.hasNext():
        found = every.next()
        full = found.getPath().toString()
        if not found.getLen() or not all(map(_scanned, full[len(base) :].strip("/").split("/"))):
            yield full


def _contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path in batch.column("path").to_pylist():
            system, inner = pa.fs.FileSystem.from_uri(path if "://" not in path else path.split("://", 1)[0] + "://" + quote(path.split("://", 1)[1]))
            with system.open_input_stream(inner) as stream:
                yield pa.record_batch([pa.array([path]), pa.array([stream.read()], pa.binary())], names=["path", "content"])


def git_commit(root: str) -> str:
    """Hash of the checked-out commit; ``unknown`` where git gives none."""
    done = _git(root, "rev-parse", "HEAD")
    return done.strip() if done else "unknown"


def changed_files(spark: SparkSession, root: str, since: str) -> DataFrame:
    """``file_path`` of files that differ between a commit and the checked-out one; none where git fails."""
    done = _git(root, "diff", f"{since}..HEAD", "--name-only") or ""
    return spark.createDataFrame([(line.strip(),) for line in done.splitlines() if line.strip()], "file_path string")


def _git(root: str, *args: str) -> str | None:
    try:
        done = subprocess.run(["git", *args], cwd=root, capture_output=True, text=True, timeout=30)
    except (OSError, subprocess.TimeoutExpired):
        return None
    return done.stdout if done.returncode == 0 else None
