"""Traversals: frontier loops of joins, one written table a round. What is sequential by nature runs in one group."""

from __future__ import annotations

from collections import deque

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeloom import storage, tables
from codeloom.operators import lookup

#: Edges that one task may order alone (about 100 bytes each); longer lists are ordered in rounds of joins.
ONE_TASK = 2_000_000
#: Nodes of a layer that one task may number alone.
ONE_SORT = 500_000


def _usable(edges: DataFrame, types, incoming: bool) -> DataFrame:
    here, there = ("target", "source") if incoming else ("source", "target")
    kept = edges if types is None else edges.where(F.col("type").isin(*types))
    return kept.select(F.col(here).alias("src"), F.col(there).alias("dst"), "type", "ord")


def bfs(edges: DataFrame, start: str, max_depth: int | None = 3, types=None, incoming: bool = False, stop_at: str | None = None) -> DataFrame:
    """``id, depth, edge_type, trail, path``: every node within ``max_depth`` edges of ``start``, without it.

    Each node comes once, with the edge that a queue would discover it by: the frontier is expanded in order of
    discovery and edges in order of ``ord``. ``trail`` (the ords along the way) sorts a level in that order;
    ``path`` has the nodes from the start on. ``stop_at`` ends the search in the round that finds that node.

    A round joins the frontier (broadcast if it is small) with the edges, keeps the best edge of each new node,
    and is written to the shared folder; edges are filtered by type, and written, before the loop. None for ``max_depth`` goes
    on until nothing new is found.
    """
    spark = edges.sparkSession
    usable = _usable(edges, types, incoming)
    if max_depth is None or max_depth > 1:  # what the edges are made of is not made anew in each round
        usable = storage.materialize(usable, "bfs-edges")
    frontier = spark.createDataFrame([(start, [], [start])], "id string, trail array<bigint>, path array<string>")
    seen = frontier.select("id")
    found, depth = [], 0
    while max_depth is None or depth < max_depth:
        depth += 1
        ends = usable.join(storage.small(frontier), usable["src"] == frontier["id"])
        steps = ends.select("dst", "type", F.concat("trail", F.array("ord")).alias("trail"), F.concat("path", F.array("dst")).alias("path"))
        best = steps.groupBy("dst").agg(F.min(F.struct("trail", "type", "path")).alias("best"))
        known = storage.small(seen.withColumnRenamed("id", "known"))
        fresh = best.join(known, best["dst"] == F.col("known"), "left_anti")
        layer = fresh.select(F.col("dst").alias("id"), F.lit(depth).alias("depth"), F.col("best.type").alias("edge_type"), "best.trail", "best.path")
        layer = storage.materialize(layer, "bfs")
        if layer.isEmpty():
            break
        found.append(layer)
        if stop_at is not None and not layer.where(F.col("id") == stop_at).isEmpty():
            break
        frontier = layer.select("id", "trail", "path")
        seen = seen.union(layer.select("id"))
    out = spark.createDataFrame([], "id string, depth int, edge_type string, trail array<bigint>, path array<string>")
    for layer in found:
        out = out.union(layer)
    return out


def callers(edges: DataFrame, node_id: str, depth: int = 3) -> DataFrame:
    """``id, depth`` of what calls a node, each once, from depth 1."""
    return bfs(edges, node_id, depth, ("calls",), incoming=True).select("id", "depth")


def callees(edges: DataFrame, node_id: str, depth: int = 3) -> DataFrame:
    return bfs(edges, node_id, depth, ("calls",)).select("id", "depth")


def impact(edges: DataFrame, node_id: str, depth: int = 2, types=tables.IMPACT_TYPES, incoming: bool = False) -> DataFrame:
    """``id, reach``: ``direct`` one edge away, else ``indirect``. Outgoing edges: what the node rests on.

    ``incoming`` asks the other way round: what rests on the node.
    """
    return bfs(edges, node_id, depth, types, incoming).select("id", F.when(F.col("depth") == 1, "direct").otherwise("indirect").alias("reach"))


def shortest_path(edges: DataFrame, start: str, end: str, max_depth: int | None = 5) -> DataFrame:
    """``step, id``: the nodes of a shortest path over edges of all types, the first that a queue would find.

    One row for start = end; none if there is no path of ``max_depth`` edges. With None the search goes on to the end.
    """
    spark = edges.sparkSession
    if start == end:
        return spark.createDataFrame([(0, start)], "step int, id string")
    found = bfs(edges, start, max_depth, stop_at=end).where(F.col("id") == end)
    return found.select(F.posexplode("path").alias("step", "id"))


def type_hierarchy(edges: DataFrame, node_id: str | None = None) -> DataFrame:
    """``id, parents, children`` by edges ``inherits`` and ``implements`` (sorted arrays); of one node or of all."""
    kin = edges.where(F.col("type").isin("inherits", "implements"))
    return relatives(kin, node_id)


def relatives(edges: DataFrame, node_id: str | None = None) -> DataFrame:
    """``id, parents, children``: targets and sources of each node's edges, in order."""
    up = edges.select(F.col("source").alias("id"), F.struct("ord", F.col("target").alias("end")).alias("p"), F.lit(None).cast("struct<ord: bigint, end: string>").alias("c"))
    down = edges.select(F.col("target").alias("id"), F.lit(None).cast("struct<ord: bigint, end: string>").alias("p"), F.struct("ord", F.col("source").alias("end")).alias("c"))
    both = up.union(down)
    if node_id is not None:
        both = both.where(F.col("id") == node_id)

    def ends(col: str):
        return F.transform(F.array_sort(F.collect_list(col)), lambda x: x["end"])

    return both.groupBy("id").agg(ends("p").alias("parents"), ends("c").alias("children"))


def adjacency(edges: DataFrame, incoming: bool = False) -> DataFrame:
    """``id, ends``: for each node its edges as (end, type, weight), in order."""
    here, there = ("target", "source") if incoming else ("source", "target")
    entry = F.struct("ord", F.col(there).alias("end"), "type", "weight")
    ordered = F.array_sort(F.collect_list(entry))
    return edges.groupBy(F.col(here).alias("id")).agg(F.transform(ordered, lambda e: F.struct(e["end"].alias("end"), e["type"].alias("type"), e["weight"].alias("weight"))).alias("ends"))


def dfs(edges: DataFrame, start: str, max_depth: int = 3, types=None) -> DataFrame:
    """``place, id, depth, edge_type``: preorder of a depth-first walk that enters each node once.

    ``depth`` is the walk's own; a node first met at the limit hides what lies behind it. The order depends on
    all that came before, so the walk itself is one task; only edges among nodes within reach are sent to it.
    """
    reach = bfs(edges, start, max_depth, types).select("id").union(edges.sparkSession.createDataFrame([(start,)], "id string"))
    usable = _usable(edges, types, incoming=False)
    near = usable.join(storage.small(reach), usable["src"] == reach["id"], "left_semi").select("src", "dst", "type", "ord", F.lit(0).alias("one"))

    def walk(part: pd.DataFrame) -> pd.DataFrame:
        out: dict[str, list] = {}
        for src, dst, kind in part.sort_values("ord")[["src", "dst", "type"]].itertuples(index=False):
            out.setdefault(src, []).append((dst, kind))
        seen, rows = {start}, []
        stack = [(0, iter(out.get(start, ())))]
        while stack:
            depth, rest = stack[-1]
            for dst, kind in rest:
                if dst in seen:
                    continue
                seen.add(dst)
                if depth < max_depth:
                    rows.append((len(rows), dst, depth + 1, kind))
                    stack.append((depth + 1, iter(out.get(dst, ()))))
                    break
            else:
                stack.pop()
        return pd.DataFrame(rows, columns=["place", "id", "depth", "edge_type"])

    return near.groupBy("one").applyInPandas(walk, "place bigint, id string, depth int, edge_type string")


def _among(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges between two of the nodes (``id``)."""
    ids = nodes.select(F.col("id").alias("node_id"))
    return edges.join(ids, edges["source"] == ids["node_id"], "left_semi").join(ids, edges["target"] == ids["node_id"], "left_semi")


def topological_order(nodes: DataFrame, edges: DataFrame, one_task: int = ONE_TASK) -> DataFrame:
    """``id, layer, trail``: Kahn's order with a queue; sort by ``layer, trail``.

    The queue begins with the nodes without incoming edges in their order; a node joins it when its last edge is
    taken away, parallel edges counting each. Nodes on circles, and behind them, come last in their own order
    (layer null, to be sorted last). Concepts are left out.

    Up to ``one_task`` edges one task runs the queue. Beyond, each round takes a layer: a node's predecessors are
    dequeued in order, so it is placed by the last of them (its number in its layer) and by the edge's place there: ``trail``.
    """
    plain = nodes.where("type <> 'concept'").select("id", "ord")
    every = storage.materialize(edges.select("source", "target", "ord"), "order-edges")
    return _queue_order(plain, _among(plain, every)) if every.count() <= one_task else _layered_order(plain, every)


def _queue_order(plain: DataFrame, inside: DataFrame) -> DataFrame:
    every = plain.select(F.lit(0).alias("one"), F.col("id").alias("source"), F.lit(None).cast("string").alias("target"), "ord").union(inside.select(F.lit(0), "source", "target", "ord"))

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("ord", kind="stable")
        ids = part.loc[part["target"].isna(), ["source", "ord"]]
        links = part.loc[part["target"].notna()]
        waits = dict.fromkeys(ids["source"], 0)
        out: dict[str, list] = {}
        for a, b in zip(links["source"], links["target"]):
            waits[b] += 1
            out.setdefault(a, []).append(b)
        queue = deque(i for i, n in waits.items() if not n)
        done = []
        while queue:
            done.append(queue.popleft())
            for b in out.get(done[-1], ()):
                waits[b] -= 1
                if not waits[b]:
                    queue.append(b)
        placed = set(done)
        rest = [i for i in ids["source"] if i not in placed]
        return pd.DataFrame({"id": done + rest, "layer": pd.array([0] * len(done) + [None] * len(rest), "Int32"), "trail": [[k] for k in range(len(done) + len(rest))]})

    return every.groupBy("one").applyInPandas(run, "id string, layer int, trail array<bigint>")


def _ranked(layer: DataFrame) -> DataFrame:
    """A written layer with ``rank``, its rows' numbers in the order of ``trail``."""
    if layer.limit(ONE_SORT + 1).count() > ONE_SORT:
        return lookup.numbered(layer, "trail", "rank")
    return layer.withColumn("rank", (F.row_number().over(Window.orderBy("trail")) - 1).cast("bigint"))


def _layered_order(plain: DataFrame, every: DataFrame) -> DataFrame:
    """Rounds over the edges that lead on; an edge is looked at until its source is placed, and no longer.

    Most edges of a graph of code lead to nodes that have none themselves: these nodes are placed after the rounds, all at once.
    """
    plain = storage.materialize(plain, "order-nodes")
    ends = plain.join(every.select(F.col("source").alias("id")).distinct().withColumn("leads", F.lit(True)), "id", "left").select(F.col("id").alias("target"), F.coalesce("leads", F.lit(False)).alias("leads")).dropDuplicates(["target"])
    split = storage.materialize(every.join(ends, "target"), "order-split", by="leads")
    leading, last = (split.where(F.col("leads") == k).drop("leads") for k in (True, False))
    ids = plain.select(F.col("id").alias("source"))
    waits = F.count("*").over(Window.partitionBy("target")).alias("waits")
    open_ = storage.materialize(leading.join(ids, "source", "left_semi").select("source", "target", "ord", waits), "order-open")
    free = plain.join(open_.select(F.col("target").alias("id")).distinct(), "id", "left_anti").join(last.join(ids, "source", "left_semi").select(F.col("target").alias("id")).distinct(), "id", "left_anti")
    layer, depth, layers = storage.materialize(free.select("id", F.array("ord").alias("trail")), "layer"), 0, []
    pending = None
    while not layer.isEmpty():
        layer = storage.materialize(_ranked(layer), "ranked-layer")
        layers.append(layer.select("id", F.lit(depth).alias("layer"), "trail", "rank"))
        met = open_.join(layer.select(F.col("id").alias("source"), "rank"), "source", "left").withColumn("met", F.col("rank").isNotNull())
        met = storage.materialize(met.select("source", "target", "ord", "waits", "rank", "met"), "order-round", by="met")
        open_ = met.where("NOT met").select("source", "target", "ord", "waits")
        freed = met.where("met").select("target", "waits", F.lit(1).cast("bigint").alias("n"), F.array("rank", "ord").alias("via"))
        # what came from an earlier layer counts, but the last layer has the last predecessor
        both = freed if pending is None else freed.union(pending)
        state = both.groupBy("target", "waits").agg(F.sum("n").alias("n"), F.max("via").alias("via")).withColumn("free", F.col("n") == F.col("waits"))
        state = storage.materialize(state, "order-pending", by="free")
        pending = state.where("NOT free").select("target", "waits", "n", F.lit(None).cast("array<bigint>").alias("via"))
        layer = state.where("free").select(F.col("target").alias("id"), F.col("via").alias("trail"))
        depth += 1
    placed = plain.limit(0).select("id", F.lit(0).alias("layer"), F.array("ord").alias("trail"), F.col("ord").alias("rank"))
    for done in layers:
        placed = placed.union(done)
    # nodes that lead nowhere: after the last of all their predecessors, if all of these are placed
    known = plain.join(placed.select("id", "layer", "rank"), "id", "left").select(F.col("id").alias("source"), "layer", "rank")
    entry = F.when(F.col("layer").isNotNull(), F.struct("layer", "rank", "ord"))
    ended = last.join(known, "source").groupBy(F.col("target").alias("id")).agg(F.count("*").alias("waits"), F.count("layer").alias("n"), F.max(entry).alias("by")).where("n = waits")
    out = placed.select("id", "layer", "trail").union(ended.select("id", F.col("by.layer") + 1, F.array("by.rank", "by.ord")))
    out = storage.materialize(out, "placed")
    rest = plain.join(out.select("id"), "id", "left_anti")
    return out.union(rest.select("id", F.lit(None).cast("int"), F.array("ord")))
