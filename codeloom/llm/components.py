"""Connected components of an edge table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Edges of a spanning forest that one task may finish alone (16 bytes each); more go on in rounds of stars.
ONE_TASK = 4_000_000


def union(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the edges and the least node of each one's component."""
    nodes, codes = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = codes[: len(a)], codes[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        new = new[new]
        while True:
            jump = new[new]
            if (jump == new).all():
                break
            new = jump
        if (new == label).all():
            return nodes, nodes[label]
        label = new


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    held = 0

    def shrink() -> None:
        nonlocal a, b, held
        nodes, root = union(np.concatenate(a), np.concatenate(b))
        out = nodes != root
        a, b, held = [nodes[out]], [root[out]], 0

    for batch in batches:
        a.append(batch.column("a").to_numpy())
        b.append(batch.column("b").to_numpy())
        held += batch.num_rows
        if held > 2_000_000:
            shrink()
    shrink()
    if len(a[0]):
        yield pa.record_batch([pa.array(a[0]), pa.array(b[0])], names=["a", "b"])


def connected_components(edges: DataFrame, one_task: int = ONE_TASK) -> DataFrame:
    """``node, component`` for every end of an edge ``a, b`` (bigint, not null); component is its least node.

    Each task first reduces its edges to a spanning forest. A forest of at most ``one_task`` edges is then
    finished by one task; a larger one by alternating large-star and small-star rounds, each written to the
    shared folder. Loops and repeated edges are harmless; nodes that only have loops do not appear.
    """
    forest = common.materialize(common.mapped(edges.select("a", "b").where("a <> b"), _forest, "a bigint, b bigint"), "forest")
    # forests of several tasks repeat each other: fewer tasks have fewer edges
    size, tasks = forest.count(), forest.rdd.getNumPartitions()
    while size > one_task > 0 and (tasks := tasks // 8):
        fewer = common.materialize(common.mapped(forest.coalesce(tasks), _forest, "a bigint, b bigint"), "forest")
        before, size = size, fewer.count()
        forest = fewer
        if size > before // 2:
            break
    if size <= one_task:
        stars = common.mapped(forest.repartition(1), _forest, "a bigint, b bigint")
    else:
        stars, before = forest, None
        while True:
            both = stars.union(stars.select("b", "a")).toDF("u", "v").distinct()
            low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
            large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
            down = large.where("u <> v").distinct()  # now every edge leads to a smaller node
            least = down.groupBy("u").agg(F.min("v").alias("m"))
            small = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
            stars = common.materialize(small.where("u <> v").distinct().toDF("a", "b"), "stars")
            now = stars.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
            if now == before:
                break
            before = now
    stars = common.materialize(stars, "components") if one_task else stars
    roots = stars.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return stars.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)


def least_near(pairs: DataFrame, rounds: int = 2) -> DataFrame:
    """``node, least`` for every end of the pairs ``a, b``: the least node within so many steps of it."""
    every = pairs.select("a", "b").union(pairs.select("b", "a")).toDF("node", "next")
    near = common.materialize(every.groupBy("node").agg(F.least(F.min("next"), F.first("node")).alias("least")), "least-near")
    for _ in range(rounds - 1):
        further = every.join(common.small(near.toDF("next", "least"), 16), "next").select("node", "least")
        near = common.materialize(near.union(further).groupBy("node").agg(F.min("least").alias("least")), "least-near")
    return near


def in_groups(pairs: DataFrame, group_pairs: int, thin: bool = False) -> DataFrame:
    """``g, a, b``: the pairs in groups that share no component, a large component in shares of about ``group_pairs``.

    A share is a hash of ``a``. With ``thin`` a large component is first cut where it is thin: pairs whose ends have the
    same least node near them stay together, for many pairs of few nodes share it, so that few nodes are in several
    groups. Whoever verifies a group may leave out pairs whose ends it has connected already: with
    them or without, the components of all that is verified are the same.
    """
    comps = connected_components(pairs)
    placed = common.materialize(pairs.join(common.small(comps, 16), pairs["a"] == comps["node"]).select("component", "a", "b"), "placed-pairs")
    large = common.materialize(_shares(placed, "component", group_pairs), "large-components")
    if not thin or large.isEmpty():
        return _split(placed, "component", large)
    few = common.small(large.select("component"), 16)
    whole = placed.join(few, "component", "left_anti").select(F.xxhash64("component").alias("g"), "a", "b")
    cut = placed.join(few, "component", "left_semi").select("a", "b")
    near = common.small(least_near(cut), 16)
    keyed = cut.join(near.toDF("a", "a_least"), "a").join(near.toDF("b", "b_least"), "b")
    keyed = common.materialize(keyed.select(F.least("a_least", "b_least").alias("key"), "a", "b"), "cut-pairs")
    return whole.union(_split(keyed, "key", common.materialize(_shares(keyed, "key", group_pairs), "large-keys")))


def _shares(placed: DataFrame, key: str, group_pairs: int) -> DataFrame:
    return placed.groupBy(key).agg(F.ceil(F.count("*") / F.lit(group_pairs)).alias("shares")).where("shares > 1")


def _split(placed: DataFrame, key: str, large: DataFrame) -> DataFrame:
    split = placed.join(common.small(large, 24), key, "left")
    share = F.pmod(F.xxhash64("a"), F.coalesce("shares", F.lit(1)))
    return split.select(F.xxhash64(key, share).alias("g"), "a", "b")
