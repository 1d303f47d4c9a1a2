"""Point lookups, filters, joins along one edge, counts, and the rules for duplicates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codeloom import storage


def node(nodes: DataFrame, node_id: str) -> DataFrame:
    return nodes.where(F.col("id") == node_id)


def nodes_by_type(nodes: DataFrame, kind: str, limit: int | None = 100) -> DataFrame:
    """Nodes of a type, the first ``limit`` by id; all of them for None."""
    found = nodes.where(F.col("type") == kind)
    return found if limit is None else found.orderBy("id").limit(limit)


def nodes_by_file(nodes: DataFrame, path: str) -> DataFrame:
    return nodes.where(F.col("file_path") == path)


def nodes_like(nodes: DataFrame, name: str, limit: int | None = 50) -> DataFrame:
    """Nodes whose name contains ``name`` in any case; ``%`` and ``_`` in it match as in LIKE."""
    found = nodes.where(F.col("name").ilike(f"%{name}%"))
    return found if limit is None else found.orderBy("id").limit(limit)


def nodes_named(nodes: DataFrame, name: str, types: tuple[str, ...] | None = None) -> DataFrame:
    """Nodes of exactly that name, of any type or of some."""
    found = nodes.where(F.col("name") == name)
    return found if types is None else found.where(F.col("type").isin(*types))


def nodes_containing(nodes: DataFrame, name: str, per_project: int = 20) -> DataFrame:
    """The first ``per_project`` nodes (by id) of each ``project`` whose name contains ``name`` in any case."""
    found = nodes.where(F.contains(F.lower("name"), F.lit(name.lower())))
    place = F.row_number().over(Window.partitionBy("project").orderBy("id"))
    return found.withColumn("place", place).where(F.col("place") <= per_project).drop("place")


def edges_by(edges: DataFrame, limit: int | None = 100, **equal: str) -> DataFrame:
    """Edges whose columns equal the given values (``source=``, ``target=``, ``type=``), the first by ``ord``."""
    found = reduce(lambda df, kv: df.where(F.col(kv[0]) == kv[1]), equal.items(), edges)
    return found if limit is None else found.orderBy("ord").limit(limit)


def edge_at(edges: DataFrame, place: int) -> DataFrame:
    return edges.where(F.col("ord") == place)


def across(nodes: DataFrame, edges: DataFrame, node_id: str, kind: str, incoming: bool = False) -> DataFrame:
    """Nodes at the other end of the edges of one type that leave a node, or that enter it."""
    here, there = ("target", "source") if incoming else ("source", "target")
    ends = edges.where((F.col(here) == node_id) & (F.col("type") == kind)).select(F.col(there).alias("end_id"), F.col("ord").alias("edge_ord"))
    return nodes.join(ends, nodes["id"] == ends["end_id"]).drop("end_id")


def children(nodes: DataFrame, edges: DataFrame, node_id: str) -> DataFrame:
    return across(nodes, edges, node_id, "contains")


def parent(nodes: DataFrame, edges: DataFrame, node_id: str) -> DataFrame:
    """The node that contains this one; of several the one whose edge came first."""
    return across(nodes, edges, node_id, "contains", incoming=True).orderBy("edge_ord").limit(1)


def imports(nodes: DataFrame, edges: DataFrame, node_id: str) -> DataFrame:
    return across(nodes, edges, node_id, "imports")


def exports(nodes: DataFrame, edges: DataFrame, node_id: str) -> DataFrame:
    return across(nodes, edges, node_id, "exports")


def calls_within(spark: SparkSession, nodes: DataFrame, edges: DataFrame, node_id: str, depth: int = 1, callees: bool = False) -> DataFrame:
    """Callers (or callees) up to ``depth`` calls away with ``level`` from 0, as a recursive query would list them.

    A node shows at each level at which some walk reaches it, the start too where calls run in a circle. Each level is
    distinct before the next is looked for: walks multiply at a hub, nodes do not.
    """
    here, there = ("source", "target") if callees else ("target", "source")
    calls = edges.where("type = 'calls'").select(F.col(here).alias("near"), F.col(there).alias("far"))
    level = calls.where(F.col("near") == node_id).select(F.col("far").alias("id")).distinct()
    found = []
    for k in range(depth):
        level = storage.materialize(level, "level")
        if level.isEmpty():
            break
        found.append(level.select("id", F.lit(k).alias("level")))
        level = calls.join(storage.small(level), calls["near"] == level["id"], "left_semi").select(F.col("far").alias("id")).distinct()
    walk = reduce(DataFrame.union, found) if found else spark.createDataFrame([], "id string, level int")
    return nodes.join(storage.materialize(walk, "walk") if found else walk, "id").select(*[nodes[c] for c in nodes.columns], "level")


def count_by_type(rows: DataFrame) -> DataFrame:
    return rows.groupBy("type").agg(F.count("*").alias("n"))


def graph_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``what, type, n``: nodes and edges by type, and in all (null type)."""
    both = nodes.select(F.lit("nodes").alias("what"), "type").union(edges.select(F.lit("edges"), "type"))
    return both.groupingSets([[F.col("what"), F.col("type")], [F.col("what")]], "what", "type").agg(F.count("*").alias("n"))


def first_wins(rows: DataFrame, *keys: str, order: str = "ord") -> DataFrame:
    """Of rows with equal keys the first; nulls are a value like others."""
    return _nth(rows, keys, F.col(order).asc())


def last_wins(rows: DataFrame, *keys: str, order: str = "ord") -> DataFrame:
    """Of rows with equal keys the last, at its own place."""
    return _nth(rows, keys, F.col(order).desc())


def _nth(rows: DataFrame, keys: tuple[str, ...], order) -> DataFrame:
    # Spark prunes rn = 1 map-side (window group limit), so that a hot key does not travel whole
    return rows.withColumn("rn_", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).where("rn_ = 1").drop("rn_")


def valid_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges both ends of which are nodes: two semi joins with the ids, which are written once and broadcast if few."""
    ids = storage.small(storage.materialize(nodes.select(F.col("id").alias("node_id")), "node-ids"))
    return edges.join(ids, edges["source"] == ids["node_id"], "left_semi").join(ids, edges["target"] == ids["node_id"], "left_semi")


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``old`` with the rows of ``new`` put over those of equal key, and added where there are none."""
    both = old.withColumn("ord", F.lit(0)).unionByName(new.withColumn("ord", F.lit(1)))
    return last_wins(both, key).drop("ord")


def numbered(rows: DataFrame, by: str, place: str = "place") -> DataFrame:
    """``rows`` with ``place``: their number from 0 in the order of a column.

    One sort over all partitions; then each row's number is the rows in the partitions before, and before it in its own.
    """
    ordered = storage.materialize(rows.orderBy(by).withColumn("part_", F.spark_partition_id()), "numbered")  # the partitions must be the same in both uses
    sizes = ordered.groupBy("part_").count()
    before = sizes.select("part_", (F.sum("count").over(Window.orderBy("part_")) - F.col("count")).alias("before_"))
    inside = F.row_number().over(Window.partitionBy("part_").orderBy(by)) - 1
    return ordered.withColumn("in_", inside).join(F.broadcast(before), "part_").withColumn(place, F.col("in_") + F.col("before_")).drop("part_", "in_", "before_")
