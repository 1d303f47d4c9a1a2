"""Keeping a stored graph up to date: from changed files to a merge, by hand or for every batch of file events."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom import storage
from codeloom.operators import incremental
from codeloom.plans import project
from codeloom.sources.store import Store


@dataclass
class Outcome:
    """What a sync did: the decision's row and the files that it was about."""

    action: str
    reason: str
    changes: DataFrame


def status(files: DataFrame, store: Store, first: int = 10) -> tuple[bool, DataFrame]:
    """(whether anything changed since the last sync, the first changed files by path)."""
    changes = incremental.hash_changes(store.load_fingerprints(), incremental.hashes(files)).where("change_class <> 'unchanged'")
    return not changes.isEmpty(), changes.orderBy("file_path").limit(first)


def sync(files: DataFrame, store: Store, force: bool = False) -> Outcome:
    """Bring the stored graph up to date with ``files`` (all files of the project).

    Content hashes tell what changed, and the decision how much has to be looked at again. Nothing: skip. Any other
    action analyses all files: a changed file's calls, imports and parents may lie in files that did not change, and
    those of unchanged files in it, so links are resolved over the whole table of symbols. Nodes, edges, layers, tour
    and project are replaced. Fingerprints are written last, so that a run that fails is repeated. ``force`` rebuilds.
    """
    new = storage.materialize(incremental.hashes(files), "hashes")
    old = store.load_fingerprints()
    changes = storage.materialize(incremental.hash_changes(old, new), "changes")
    decision = incremental.classify_update(changes, old.count(), old).first()
    graph = store.load_graph()
    action = "FULL_UPDATE" if force or graph is None else decision["action"]
    if action == "SKIP":
        return Outcome(action, decision["reason"], changes)
    known = graph["project"].first() if graph is not None and graph["project"] is not None else None
    about = {"name": known["name"] or "project", "commit": known["git_commit_hash"] or "unknown"} if known else {}
    made = project.analyze(files, **about)
    store.save_graph(made.nodes, made.edges, made.layers, made.tour, made.project)
    store.save_fingerprints(new)
    return Outcome(action, decision["reason"], changes)


def watch(events: DataFrame, store: Store, read_files, checkpoint: str, key: str = "path"):
    """A running query that syncs once for every batch of (debounced) file events with at least one row.

    ``read_files()`` gives the project's files as they are then. A batch that fails is tried again by Spark.
    """

    def each(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            sync(read_files(), store)

    return events.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).start()
