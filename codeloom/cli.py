"""Command line: analyse folders, ask the stored graph, keep it up to date. ``python -m codeloom.cli --help``."""

from __future__ import annotations

import argparse
import itertools
import time
from functools import reduce
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.functions import columns as C
from codeloom.operators import lookup, resolve
from codeloom.plans import project
from codeloom.sources import files as file_source
from codeloom.sources import ignore
from codeloom.sources.store import Store
from codeloom.streaming import sync

OUTPUT = ".codeloom/graph"


def _store(spark: SparkSession, root: str, kind: str = "parquet") -> Store:
    return Store(spark, f"{root.rstrip('/')}/{OUTPUT}", kind)


def _files(spark: SparkSession, root: str) -> DataFrame:
    return file_source.read_files(spark, root, ignore.load_spec(root))


def projects_of(folder: str) -> list[str]:
    """Each sub-folder (but hidden ones) is a project."""
    return [str(p) for p in sorted(Path(folder).iterdir()) if p.is_dir() and not p.name.startswith(".")]


def _all(spark: SparkSession, roots: list[str], name: str) -> DataFrame:
    found = [(r, _store(spark, r).read(name)) for r in roots]
    parts = [df.withColumn("project", F.lit(Path(r).name)) for r, df in found if df is not None]
    if not parts:
        raise SystemExit("no stored graph; run analyze first")
    return reduce(DataFrame.unionByName, parts)


def query(spark: SparkSession, roots: list[str], name: str) -> DataFrame:
    """Nodes whose name contains ``name``, the first twenty of each project."""
    return lookup.nodes_containing(_all(spark, roots, "nodes"), name).select("project", "id", "type", "name", "file_path")


def stats(spark: SparkSession, roots: list[str]) -> DataFrame:
    """Nodes and edges by project and type."""
    both = [_all(spark, roots, t).select("project", F.lit(t).alias("what"), "type") for t in ("nodes", "edges")]
    return both[0].union(both[1]).groupBy("project", "what", "type").agg(F.count("*").alias("n")).orderBy("project", "what", "type")


def symbol(spark: SparkSession, roots: list[str], name: str) -> DataFrame:
    """Functions, classes and variables of exactly that name."""
    return lookup.nodes_named(_all(spark, roots, "nodes"), name, ("function", "class", "variable")).select("project", "id", "type", "file_path", "line_start")


def references(spark: SparkSession, root: str, path: str, language: str | None = None) -> DataFrame:
    """Import-like lines of one file, each a reference whose symbol is the whole line, as far as a name settles it."""
    lines = _files(spark, root).where(F.col("path") == path).select(F.explode(F.split("content", "\n")).alias("line")).select(F.trim("line").alias("symbol"))
    wanted = lines.where(F.col("symbol").rlike(r"^(?:import |from |#include|require\(|use )"))
    lang = F.lit(language) if language else C.language_of(F.lit(path))
    refs = wanted.where(~C.is_builtin(F.col("symbol"), lang)).select(F.lit(path).alias("source_file"), "symbol", F.lit("import").alias("ref_type"))
    nodes = _all(spark, [root], "nodes").where(F.col("type").isin("function", "class", "variable"))
    known = nodes.select("name", F.col("file_path").alias("file"), F.col("type").alias("kind"), F.col("id").alias("ord"))
    return resolve.by_name(refs, known, known.select("file", "name", "ord"))


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="codeloom", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    for name, text in (("analyze", "analyse folders and store their graphs"), ("build", "analyse each sub-folder as a project"), ("stats", "count nodes and edges"), ("query", "find nodes by name"), ("symbol", "find a symbol"), ("references", "resolve the imports of a file"), ("status", "what changed since the last sync"), ("sync", "bring the stored graph up to date"), ("watch", "sync again and again")):
        one = commands.add_parser(name, help=text)
        if name in ("query", "symbol", "references"):
            one.add_argument("what")
        if name == "references":
            one.add_argument("--language")
        if name == "sync":
            one.add_argument("--force", action="store_true")
        if name == "watch":
            one.add_argument("--seconds", type=float, default=2.0, help="pause between two looks")
            one.add_argument("--rounds", type=int, default=0, help="looks to take; 0 for no end")
        if name in ("analyze", "build"):
            one.add_argument("--backend", choices=("parquet", "json"), default="parquet")
        one.add_argument("-p", "--project", action="append", default=[])
    args = parser.parse_args(argv)
    spark = SparkSession.builder.appName("codeloom").getOrCreate()
    roots = [str(Path(p).resolve()) for p in args.project or ["."]]
    if args.command in ("analyze", "build"):
        for root in roots if args.command == "analyze" else [p for r in roots for p in projects_of(r)]:
            made = project.analyze_folder(spark, root, _store(spark, root, args.backend))
            print(f"{root}: {made.nodes.count()} nodes, {made.edges.count()} edges")
    elif args.command == "status":
        for root in roots:
            stale, first = sync.status(_files(spark, root), _store(spark, root))
            print(f"{root}: {'changed' if stale else 'up to date'}")
            first.show(truncate=False)
    elif args.command == "watch":
        for turn in itertools.count(1):
            for root in roots:
                done = sync.sync(_files(spark, root), _store(spark, root))
                if done.action != "SKIP":
                    print(f"{root}: {done.action}: {done.reason}", flush=True)
            if turn == args.rounds:
                break
            time.sleep(args.seconds)
    elif args.command == "sync":
        for root in roots:
            done = sync.sync(_files(spark, root), _store(spark, root), args.force)
            print(f"{root}: {done.action}: {done.reason}")
    else:
        shown = {"stats": lambda: stats(spark, roots), "query": lambda: query(spark, roots, args.what), "symbol": lambda: symbol(spark, roots, args.what), "references": lambda: references(spark, roots[0], args.what, args.language)}
        shown[args.command]().show(1000, truncate=False)


if __name__ == "__main__":
    main()
