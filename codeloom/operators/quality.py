"""Cleaning of graphs from unreliable producers: sanitise, map aliases, fill gaps, validate, keep references whole.

Raw nodes have ``ord, id, type, name, file_path, summary, tags, complexity, language_notes``; raw edges ``ord, source,
target, type, direction, description, weight, weight_text`` (a weight is a number, a text, or missing).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom import storage, tables
from codeloom.functions import columns as C
from codeloom.operators import lookup

FIXED, DROPPED, FATAL = "auto-corrected", "dropped", "fatal"
_ISSUE = "array<struct<level: string, category: string, message: string, path: string>>"


def _swap(df: DataFrame, **new: Column) -> DataFrame:
    return df.withColumns(new)


def sanitize_nodes(nodes: DataFrame) -> DataFrame:
    """Type and complexity in lower case."""
    return _swap(nodes, type=F.lower("type"), complexity=F.lower("complexity"))


def sanitize_edges(edges: DataFrame) -> DataFrame:
    return _swap(edges, type=F.lower("type"), direction=F.lower("direction"))


def alias_nodes(nodes: DataFrame) -> DataFrame:
    """Type aliases by their canonical type; ``interface`` becomes ``class``."""
    return _swap(nodes, type=F.coalesce(C.mapped(F.col("type"), tables.NODE_ALIASES), F.col("type")))


def alias_edges(edges: DataFrame) -> DataFrame:
    """Likewise; ``references`` becomes ``cites``."""
    return _swap(edges, type=F.coalesce(C.mapped(F.col("type"), tables.EDGE_ALIASES), F.col("type")))


def _issue(when: Column, category: str, message: Column, path: Column, level: str = FIXED) -> Column:
    return F.when(when, F.struct(F.lit(level).alias("level"), F.lit(category).alias("category"), message.alias("message"), path.alias("path")))


def _says(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("null")) for p in parts])


def _blank(col: str) -> Column:
    return F.coalesce(F.col(col) == "", F.lit(True))


def autofix_nodes(nodes: DataFrame) -> DataFrame:
    """Missing type file, complexity moderate (or its alias), tags none, summary the name; ``issues`` has one entry a fix."""
    at = F.col("ord")
    name = F.coalesce(F.nullif(F.col("name"), F.lit("")), F.nullif(F.col("id"), F.lit("")), _says("index ", at))
    level = C.mapped(F.col("complexity"), tables.COMPLEXITY_ALIASES)
    here = [_says("nodes[", at, '] ("', name, '"): '), _says("nodes[", at, "].")]

    def missing(when: Column, field: str, value: str) -> Column:
        return _issue(when, "missing-field", F.concat(here[0], F.lit(f'missing "{field}" — defaulted to {value}')), F.concat(here[1], F.lit(field)))

    issues = [
        missing(_blank("type"), "type", '"file"'),
        missing(_blank("complexity"), "complexity", '"moderate"'),
        _issue(level.isNotNull(), "alias", F.concat(here[0], _says('complexity "', F.col("complexity"), '" — mapped to "', level, '"')), F.concat(here[1], F.lit("complexity"))),
        missing(F.col("tags").isNull(), "tags", "[]"),
        missing(_blank("summary"), "summary", "name"),
    ]
    return _swap(
        nodes,
        issues=F.array_compact(F.array(*issues)).cast(_ISSUE),
        type=F.when(_blank("type"), "file").otherwise(F.col("type")),
        complexity=F.when(_blank("complexity"), "moderate").otherwise(F.coalesce(level, "complexity")),
        tags=F.coalesce("tags", F.expr("cast(array() as array<string>)")),
        summary=F.when(_blank("summary"), name).otherwise(F.col("summary")),
    )


def autofix_edges(edges: DataFrame) -> DataFrame:
    """Missing type depends_on, direction forward (or its alias), weight 0.5; texts read as numbers, weights held to 0..1."""
    at = F.col("ord")
    turned = C.mapped(F.col("direction"), tables.DIRECTION_ALIASES)
    text, number = F.col("weight_text"), F.col("weight")
    read = F.expr("try_cast(trim(weight_text) AS double)")
    given = F.coalesce(number, F.when(text.isNotNull(), F.coalesce(read, F.lit(0.5))), F.lit(0.5))
    held = F.least(F.greatest(given, F.lit(0.0)), F.lit(1.0))
    said = number.isNull() & text.isNotNull()

    def here(*parts) -> Column:
        return F.concat(_says("edges[", at, "]: "), _says(*parts))

    def path(field: str) -> Column:
        return _says("edges[", at, f"].{field}")

    issues = [
        _issue(_blank("type"), "missing-field", here('missing "type" — defaulted to "depends_on"'), path("type")),
        _issue(_blank("direction"), "missing-field", here('missing "direction" — defaulted to "forward"'), path("direction")),
        _issue(turned.isNotNull(), "alias", here('direction "', F.col("direction"), '" — mapped to "', turned, '"'), path("direction")),
        _issue(number.isNull() & text.isNull(), "missing-field", here('missing "weight" — defaulted to 0.5'), path("weight")),
        _issue(said & read.isNotNull(), "type-coercion", here('weight was string "', text, '" — coerced to number'), path("weight")),
        _issue(said & read.isNull(), "type-coercion", here('weight "', text, '" is not a valid number — defaulted to 0.5'), path("weight")),
        _issue((given < 0) | (given > 1), "out-of-range", here("weight ", given, " out of range — clamped to ", held), path("weight")),
    ]
    return _swap(
        edges,
        issues=F.array_compact(F.array(*issues)).cast(_ISSUE),
        type=F.when(_blank("type"), "depends_on").otherwise(F.col("type")),
        direction=F.when(_blank("direction"), "forward").otherwise(F.coalesce(turned, "direction")),
        weight=held,
    ).drop("weight_text")


def node_fault() -> Column:
    """Why a fixed node is not valid; null if it is."""
    return (
        F.when(F.col("id").isNull(), "id is missing")
        .when(F.col("name").isNull(), "name is missing")
        .when(~F.col("type").isin(*tables.NODE_TYPES), F.concat(F.lit("unknown type "), "type"))
        .when(~F.col("complexity").isin(*tables.COMPLEXITIES), F.concat(F.lit("unknown complexity "), "complexity"))
    )


def edge_fault() -> Column:
    return (
        F.when(F.col("source").isNull() | F.col("target").isNull(), "an end is missing")
        .when(~F.col("type").isin(*tables.EDGE_TYPES), F.concat(F.lit("unknown type "), "type"))
        .when(~F.col("direction").isin(*tables.DIRECTIONS), F.concat(F.lit("unknown direction "), "direction"))
        .when(F.isnan("weight"), "weight is no number")
    )


def _dropped(rows: DataFrame, kind: str) -> DataFrame:
    at = F.concat(F.lit(f"{kind}["), F.col("ord").cast("string"), F.lit("]"))
    return rows.select(F.lit(DROPPED).alias("level"), F.lit(f"invalid-{kind}").alias("category"), F.concat(at, F.lit(": "), "fault", F.lit(" — removed")).alias("message"), at.alias("path"))


def checked_ends(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``edges`` with ``missing``: null, or which end is no node (``source``, ``target`` or ``both``)."""
    ids = nodes.select(F.col("id").alias("end_id"), F.lit(True).alias("there")).where("end_id IS NOT NULL").distinct()
    a, b = ids.toDF("s_id", "s_there"), ids.toDF("t_id", "t_there")
    both = edges.join(a, edges["source"] == a["s_id"], "left").join(b, edges["target"] == b["t_id"], "left")
    lost = F.when(F.col("s_there").isNull() & F.col("t_there").isNull(), "both").when(F.col("s_there").isNull(), "source").when(F.col("t_there").isNull(), "target")
    return both.withColumn("missing", lost).drop("s_id", "s_there", "t_id", "t_there")


@dataclass
class Validation:
    """What :func:`validate` gives; ``fatal`` is the reason why there is no graph, else None."""

    nodes: DataFrame
    edges: DataFrame
    issues: DataFrame
    layers: DataFrame | None = None
    tour: DataFrame | None = None
    fatal: str | None = None

    @property
    def success(self) -> bool:
        return self.fatal is None

    def errors(self) -> DataFrame:
        """``message``: the fatal one first, then those of the issues."""
        said = self.issues.select("message")
        if self.fatal is None:
            return said
        return said.sparkSession.createDataFrame([(self.fatal,)], "message string").union(said.where(F.col("message") != self.fatal))


def fixed_nodes(nodes: DataFrame) -> DataFrame:
    return autofix_nodes(alias_nodes(sanitize_nodes(nodes)))


def fixed_edges(edges: DataFrame) -> DataFrame:
    return autofix_edges(alias_edges(sanitize_edges(edges)))


def valid_nodes(nodes: DataFrame) -> DataFrame:
    return fixed_nodes(nodes).where(node_fault().isNull()).drop("issues")


def valid_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Valid edges both ends of which are among ``nodes`` (valid ones)."""
    return lookup.valid_edges(fixed_edges(edges).where(edge_fault().isNull()).drop("issues"), nodes)


def issues_of(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``level, category, message, path`` of all that was fixed or dropped."""
    n = fixed_nodes(nodes).withColumn("fault", node_fault())
    e = fixed_edges(edges).withColumn("fault", edge_fault())
    kept = n.where("fault IS NULL").select("id")
    ends = checked_ends(e.where("fault IS NULL"), kept).where("missing IS NOT NULL")
    end = F.when(F.col("missing") == "target", "target").otherwise("source")
    broken = ends.select(
        F.lit(DROPPED).alias("level"),
        F.lit("invalid-reference").alias("category"),
        F.concat(F.lit("edges["), F.col("ord").cast("string"), F.lit("]: "), end, F.lit(' "'), F.when(end == "target", F.col("target")).otherwise(F.col("source")), F.lit('" does not exist in nodes — removed')).alias("message"),
        F.concat(F.lit("edges["), F.col("ord").cast("string"), F.lit("]."), end).alias("path"),
    )
    return n.select(F.inline("issues")).union(e.select(F.inline("issues"))).union(_dropped(n.where("fault IS NOT NULL"), "nodes")).union(_dropped(e.where("fault IS NOT NULL"), "edges")).union(broken)


def known_ids(rows: DataFrame, nodes: DataFrame, key: str) -> DataFrame:
    """``rows`` (layers, tour steps) with only those ``node_ids`` that are nodes, in their order."""
    each = rows.select(key, F.posexplode("node_ids").alias("pos", "node_id"))
    ids = nodes.select(F.col("id").alias("node_id")).distinct()
    kept = each.join(ids, "node_id", "left_semi").groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "node_id"))), lambda x: x["node_id"]).alias("kept_ids"))
    return rows.join(kept, key, "left").withColumn("node_ids", F.coalesce("kept_ids", F.expr("cast(array() as array<string>)"))).drop("kept_ids")


def validate(nodes: DataFrame, edges: DataFrame, project: DataFrame | None = None, layers: DataFrame | None = None, tour: DataFrame | None = None) -> Validation:
    """The whole pass. Fatal: no project row with a name, or no valid node; the tables are then as far as they came."""
    good = storage.materialize(valid_nodes(nodes), "valid-nodes")
    kept = valid_edges(edges, good)
    fatal = None
    if project is not None and project.where("name IS NOT NULL").isEmpty():
        fatal = "Missing or invalid project metadata"
    elif good.isEmpty():
        fatal = "No valid nodes found in knowledge graph"
    return Validation(good, kept, issues_of(nodes, edges), None if layers is None else known_ids(layers, good, "id"), None if tour is None else known_ids(tour, good, "order"), fatal)


# batches of a producer whose ids are not canonical


def flow_slugs(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``step_id, flow``: slug of the flow that a step belongs to, by the last edge that says so."""
    names = nodes.where("type = 'flow' AND id <> '' AND name <> ''").select(F.col("id").alias("flow_id"), F.replace(F.lower("name"), F.lit(" "), F.lit("-")).alias("flow"), F.col("ord").alias("n_ord"))
    names = lookup.last_wins(names, "flow_id", order="n_ord")
    steps = edges.where("type = 'flow_step' AND source <> '' AND target <> ''").select(F.col("source").alias("flow_id"), F.col("target").alias("step_id"), "ord")
    return lookup.last_wins(steps.join(names, "flow_id"), "step_id").select("step_id", "flow")


def canonical_nodes(nodes: DataFrame, edges: DataFrame | None = None) -> DataFrame:
    """``nodes`` with ``old_id`` and canonical ``id`` and ``complexity``; duplicates are still there."""
    kind = F.coalesce("type", F.lit("file"))
    if edges is None:
        flagged = nodes.withColumn("flow", F.lit(None).cast("string"))
    else:
        flows = flow_slugs(nodes, edges)
        flagged = nodes.join(flows, (nodes["type"] == "step") & (nodes["id"] == flows["step_id"]), "left").drop("step_id")
    new = C.canonical_id(F.coalesce("id", F.lit("")), kind, F.col("file_path"), F.col("name"), F.col("flow"))
    out = flagged.withColumns({"old_id": F.coalesce("id", F.lit("")), "id": new}).drop("flow")
    scale = F.expr("try_cast(complexity AS double)")
    word = F.when(scale.isNull(), F.col("complexity"))
    return out.withColumn("new_complexity", F.when(F.col("complexity").isNotNull(), C.canonical_complexity(word, scale)))


@dataclass
class Batch:
    """A normalised batch: unique nodes, kept edges, dangling ones with their ``reason``, the id map, and counts."""

    nodes: DataFrame
    edges: DataFrame
    dropped: DataFrame
    id_map: DataFrame
    stats: DataFrame


def normalize_batch(nodes: DataFrame, edges: DataFrame) -> Batch:
    """Canonical ids for nodes (the last of equal ones stays), edges rewritten to them (the first of equal ones stays).

    An end that no node had is made canonical by itself and tried again. Edges without a node at both ends are
    dropped with a reason. ``complexity`` is text; a number in it is read as a scale.
    """
    canonical = storage.materialize(canonical_nodes(nodes, edges), "canonical-nodes")
    kept = lookup.last_wins(canonical, "id")
    id_map = lookup.last_wins(canonical.select("old_id", "id", "ord"), "old_id").select("old_id", F.col("id").alias("new_id"))
    ids = kept.select(F.col("id").alias("valid_id")).distinct()
    every = edges.select("*", F.col("source").alias("old_source"), F.col("target").alias("old_target"))
    for end in ("source", "target"):
        there = id_map.toDF("m_old", "m_new")
        every = every.join(there, every[f"old_{end}"] == there["m_old"], "left").withColumn(end, F.coalesce("m_new", f"old_{end}")).drop("m_old", "m_new")
        again = C.canonical_id(F.col(end), C.type_of_id(F.col(end)), F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(None).cast("string"))
        a, b = ids.toDF("v1"), ids.toDF("v2")
        every = every.withColumn("again", again).join(a, F.col(end) == a["v1"], "left").join(b, F.col("again") == b["v2"], "left")
        every = every.withColumn(end, F.when(F.col("v1").isNull() & F.col("v2").isNotNull(), F.col("again")).otherwise(F.col(end)))
        every = every.withColumn(f"{end}_lost", F.col("v1").isNull() & F.col("v2").isNull()).drop("again", "v1", "v2")
    every = storage.materialize(every, "rewritten-edges")
    reason = F.when(F.col("source_lost") & F.col("target_lost"), "missing-both").when(F.col("source_lost"), "missing-source").when(F.col("target_lost"), "missing-target")
    dropped = every.withColumn("reason", reason).where("reason IS NOT NULL").select("source", "target", "type", "reason", "ord")
    good = lookup.first_wins(every.where("NOT source_lost AND NOT target_lost"), "source", "target", "type")
    n = canonical.agg(F.count_if(F.col("id") != F.col("old_id")).alias("ids_fixed"), F.count_if(F.col("new_complexity") != F.col("complexity")).alias("complexity_fixed"))
    e = every.agg(F.count_if((F.col("source") != F.col("old_source")) | (F.col("target") != F.col("old_target"))).alias("edges_rewritten"), F.count_if(F.col("source_lost") | F.col("target_lost")).alias("dangling_edges_dropped"))
    out = kept.withColumn("complexity", F.col("new_complexity")).drop("new_complexity", "old_id")
    return Batch(out, good.drop("old_source", "old_target", "source_lost", "target_lost"), dropped, id_map, n.crossJoin(e))
