"""Queries over the test tables, one or more for each operator, and the same questions in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom import storage, tables
from codeloom.extract import registry
from codeloom.functions import columns as C
from codeloom.operators import graph, incremental, layers, lookup, quality, resolve, search
from codeloom.plans import project
from codeloom.sources import ignore
from codeloom.sources import testgraph as G
from codeloom.streaming import events as streams

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its name, with its SQL where there is one."""

    def add(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return add


BAND = G.BAND


def _pick(values, key: str) -> str:
    return "CASE " + " ".join(f"WHEN {key} % {len(values)} = {i} THEN '{v}'" for i, v in enumerate(values)) + " END"


_PATH = f"'src/' || {_pick(G.FOLDERS, '%s')} || '/customer' || %s || '.' || {_pick(G.SUFFIXES, '%s')}"


def _customer_path(key: str) -> str:
    return _PATH.replace("%s", key)


NODES = f"""nodes AS (
  SELECT 'region:' || r_regionkey AS id, 'domain' AS type, r_name AS name, NULL::VARCHAR AS file_path, 'Region ' || r_name AS summary, []::VARCHAR[] AS tags, 'simple' AS complexity, NULL::VARCHAR AS language_notes, r_regionkey::BIGINT AS ord FROM region
  UNION ALL SELECT 'nation:' || n_nationkey, 'module', n_name, NULL, 'Nation ' || n_name, [], 'simple', NULL, {BAND} + n_nationkey FROM nation
  UNION ALL SELECT 'customer:' || c_custkey, 'service', c_name, {_customer_path('c_custkey')}, 'Service of segment ' || c_mktsegment, [lower(c_mktsegment)], CASE WHEN c_acctbal < 0 THEN 'simple' WHEN c_acctbal < 5000 THEN 'moderate' ELSE 'complex' END, NULL, {2 * BAND} + c_custkey FROM customer
  UNION ALL SELECT 'supplier:' || s_suppkey, 'resource', s_name, NULL, 'Supplier with balance ' || trunc(s_acctbal)::INT, [], 'simple', NULL, {3 * BAND} + s_suppkey FROM supplier
  UNION ALL SELECT 'part:' || p_partkey, 'class', p_name, NULL, p_name || ' by ' || p_brand, string_split(lower(p_type), ' '), 'simple', lower(p_type), {4 * BAND} + p_partkey FROM part
  UNION ALL SELECT 'order:' || o_orderkey, 'function', 'order_' || o_orderkey, {_customer_path('o_custkey')}, 'Order of priority ' || o_orderpriority, [lower(o_orderstatus)], CASE WHEN o_totalprice < 100000 THEN 'simple' WHEN o_totalprice < 200000 THEN 'moderate' ELSE 'complex' END, NULL, {5 * BAND} + o_orderkey FROM orders)"""
EDGES = f"""edges AS (
  SELECT 'region:' || n_regionkey AS source, 'nation:' || n_nationkey AS target, 'contains' AS type, 'forward' AS direction, 1.0::DOUBLE AS weight, n_nationkey::BIGINT AS ord FROM nation
  UNION ALL SELECT 'nation:' || c_nationkey, 'customer:' || c_custkey, 'contains', 'forward', 1.0, {BAND} + c_custkey FROM customer
  UNION ALL SELECT 'order:' || o_orderkey, 'customer:' || o_custkey, 'calls', 'forward', 0.8, {2 * BAND} + o_orderkey FROM orders
  UNION ALL SELECT 'order:' || k, 'order:' || t, 'calls', 'forward', 0.8, {3 * BAND} + k FROM (SELECT o_orderkey AS k, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS t FROM orders) WHERE t IS NOT NULL
  UNION ALL SELECT 'order:' || l_orderkey, 'part:' || l_partkey, 'imports', 'forward', 0.7, {4 * BAND} + l_orderkey * 1000 + turn FROM (SELECT *, dense_rank() OVER (PARTITION BY l_orderkey ORDER BY l_partkey) AS turn FROM lineitem) GROUP BY l_orderkey, l_partkey, turn
  UNION ALL SELECT 'order:' || l_orderkey, 'supplier:' || l_suppkey, 'depends_on', 'forward', max(l_discount) * 10, {5 * BAND} + l_orderkey * 1000 + turn FROM (SELECT *, dense_rank() OVER (PARTITION BY l_orderkey ORDER BY l_suppkey) AS turn FROM lineitem) GROUP BY l_orderkey, l_suppkey, turn)"""
BOTH = f"{NODES},\n{EDGES}"
_DIRTY_NODES = """dirty AS (
  SELECT ord, CASE WHEN ord % 29 <> 0 THEN id END AS id,
    CASE WHEN ord % 7 = 0 THEN upper(type) WHEN ord % 7 = 1 THEN CASE type WHEN 'function' THEN 'Func' WHEN 'class' THEN 'struct' WHEN 'module' THEN 'PKG' WHEN 'service' THEN 'pod' ELSE type END WHEN ord % 7 = 2 THEN NULL WHEN ord % 7 = 3 THEN 'gadget' ELSE type END AS type,
    CASE WHEN ord % 13 <> 0 THEN name END AS name, file_path,
    CASE WHEN ord % 11 = 0 THEN '' ELSE summary END AS summary, CASE WHEN ord % 3 <> 0 THEN tags END AS tags,
    CASE WHEN ord % 5 = 0 THEN 'HIGH' WHEN ord % 5 = 1 THEN NULL WHEN ord % 5 = 2 THEN 'easy' WHEN ord % 23 = 3 THEN 'weird' ELSE complexity END AS complexity
  FROM nodes)"""
_DIRTY_EDGES = """dirty AS (
  SELECT ord, source, CASE WHEN ord % 17 = 0 THEN 'ghost:' || ord ELSE target END AS target,
    CASE WHEN ord % 7 = 0 THEN upper(type) WHEN ord % 7 = 1 THEN 'Invokes' WHEN ord % 7 = 2 THEN NULL WHEN ord % 19 = 3 THEN 'nope' ELSE type END AS type,
    CASE WHEN ord % 5 = 0 THEN 'TO' WHEN ord % 5 = 1 THEN NULL WHEN ord % 5 = 2 THEN 'both' WHEN ord % 31 = 3 THEN 'sideways' ELSE direction END AS direction,
    CASE WHEN ord % 9 = 5 THEN 1.7 WHEN ord % 9 = 6 THEN -0.2 WHEN ord % 9 > 6 THEN weight END AS weight,
    CASE WHEN ord % 9 = 1 THEN 'abc' WHEN ord % 9 = 2 THEN '1.7' WHEN ord % 9 = 3 THEN '0.25' END AS weight_text
  FROM edges)"""


def _case(column: str, table: dict[str, str], other: str) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items()) + f" ELSE {other} END"


def _in(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


_FIXED_NODES = f"""{_DIRTY_NODES.replace('dirty AS', 'dirty_n AS')},
fixed_n AS (SELECT ord, id, name, file_path,
    CASE WHEN coalesce(type, '') = '' THEN 'file' ELSE {_case('lower(type)', tables.NODE_ALIASES, 'lower(type)')} END AS type,
    CASE WHEN coalesce(complexity, '') = '' THEN 'moderate' ELSE {_case('lower(complexity)', tables.COMPLEXITY_ALIASES, 'lower(complexity)')} END AS complexity,
    coalesce(nullif(summary, ''), nullif(name, ''), nullif(id, ''), 'index ' || ord) AS summary, coalesce(tags, []) AS tags FROM dirty_n),
good_n AS (SELECT * FROM fixed_n WHERE id IS NOT NULL AND name IS NOT NULL AND type IN {_in(tables.NODE_TYPES)} AND complexity IN {_in(tables.COMPLEXITIES)})"""
_FIXED_EDGES = f"""{_DIRTY_EDGES.replace('dirty AS', 'dirty_e AS')},
fixed_e AS (SELECT ord, source, target,
    CASE WHEN coalesce(type, '') = '' THEN 'depends_on' ELSE {_case('lower(type)', tables.EDGE_ALIASES, 'lower(type)')} END AS type,
    CASE WHEN coalesce(direction, '') = '' THEN 'forward' ELSE {_case('lower(direction)', tables.DIRECTION_ALIASES, 'lower(direction)')} END AS direction,
    least(greatest(coalesce(weight, TRY_CAST(weight_text AS DOUBLE), 0.5), 0), 1) AS weight FROM dirty_e),
good_e AS (SELECT * FROM fixed_e WHERE type IN {_in(tables.EDGE_TYPES)} AND direction IN {_in(tables.DIRECTIONS)})"""


def _e(spark: SparkSession, root: str) -> DataFrame:
    return G.edges(spark, root)


def _n(spark: SparkSession, root: str) -> DataFrame:
    return G.nodes(spark, root)


_FLAT = ["id", "type", "name", "file_path", "summary", "complexity"]
_FLAT_SQL = ", ".join(_FLAT)

# lookups


@query(f"WITH {NODES} SELECT {_FLAT_SQL} FROM nodes WHERE id = 'order:7'")
def node_by_id(s, d):
    return lookup.node(_n(s, d), "order:7").select(_FLAT)


@query(f"WITH {NODES} SELECT {_FLAT_SQL} FROM nodes WHERE type = 'service' ORDER BY id LIMIT 100")
def nodes_by_type(s, d):
    return lookup.nodes_by_type(_n(s, d), "service").select(_FLAT)


@query(f"WITH {NODES} SELECT {_FLAT_SQL} FROM nodes WHERE file_path = (SELECT {_customer_path('1')})")
def nodes_by_file(s, d):
    return lookup.nodes_by_file(_n(s, d), "src/services/customer1.ts").select(_FLAT)


@query(f"WITH {NODES} SELECT {_FLAT_SQL} FROM nodes WHERE name ILIKE '%WIDGET%' ORDER BY id LIMIT 50")
def nodes_by_name_like(s, d):
    return lookup.nodes_like(_n(s, d), "WIDGET").select(_FLAT)


@query(f"WITH {NODES} SELECT {_FLAT_SQL} FROM nodes WHERE name = 'order_11' AND type IN ('function', 'class', 'variable')")
def symbol_by_name(s, d):
    return lookup.nodes_named(_n(s, d), "order_11", ("function", "class", "variable")).select(_FLAT)


@query(f"WITH {NODES} SELECT id, name, type AS project FROM nodes WHERE contains(lower(name), 'er') QUALIFY row_number() OVER (PARTITION BY type ORDER BY id) <= 20")
def nodes_containing_per_project(s, d):
    return lookup.nodes_containing(_n(s, d).withColumn("project", F.col("type")), "ER").select("id", "name", "project")


@query(f"WITH {EDGES} SELECT source, target, type, weight FROM edges WHERE type = 'depends_on' ORDER BY ord LIMIT 100")
def edges_by_type(s, d):
    return lookup.edges_by(_e(s, d), type="depends_on").select("source", "target", "type", "weight")


@query(f"WITH {EDGES} SELECT source, target, type, weight FROM edges WHERE source = 'order:7' ORDER BY ord LIMIT 100")
def edges_by_source(s, d):
    return lookup.edges_by(_e(s, d), source="order:7").select("source", "target", "type", "weight")


@query(f"WITH {EDGES} SELECT source, target, type, weight FROM edges WHERE target = 'part:3' ORDER BY ord LIMIT 100")
def edges_by_target(s, d):
    return lookup.edges_by(_e(s, d), target="part:3").select("source", "target", "type", "weight")


@query(f"WITH {EDGES} SELECT source, target, type, weight FROM edges WHERE source = 'nation:3' AND target = (SELECT 'customer:' || min(c_custkey) FROM customer WHERE c_nationkey = 3)")
def edges_between(s, d):
    first = G.table(s, d, "customer").where("c_nationkey = 3").agg(F.min("c_custkey")).first()[0]
    return lookup.edges_by(_e(s, d), limit=None, source="nation:3", target=f"customer:{first}").select("source", "target", "type", "weight")


@query(f"WITH {BOTH} SELECT n.id, n.name, n.type FROM edges e JOIN nodes n ON n.id = e.target WHERE e.source = 'nation:3' AND e.type = 'contains'")
def children_of(s, d):
    return lookup.children(_n(s, d), _e(s, d), "nation:3").select("id", "name", "type")


@query(f"WITH {BOTH} SELECT n.id, n.name, n.type FROM edges e JOIN nodes n ON n.id = e.source WHERE e.target = 'customer:7' AND e.type = 'contains' ORDER BY e.ord LIMIT 1")
def parent_of(s, d):
    return lookup.parent(_n(s, d), _e(s, d), "customer:7").select("id", "name", "type")


@query(f"WITH {BOTH} SELECT n.id, n.name, n.type FROM edges e JOIN nodes n ON n.id = e.target WHERE e.source = 'order:7' AND e.type = 'imports'")
def imports_of(s, d):
    return lookup.imports(_n(s, d), _e(s, d), "order:7").select("id", "name", "type")


@query(f"WITH {NODES} SELECT type, count(*) AS n FROM nodes GROUP BY type")
def count_nodes_by_type(s, d):
    return lookup.count_by_type(_n(s, d))


@query(f"WITH {BOTH} SELECT 'nodes' AS what, type, count(*) AS n FROM nodes GROUP BY type UNION ALL SELECT 'edges', type, count(*) FROM edges GROUP BY type UNION ALL SELECT 'nodes', NULL, count(*) FROM nodes UNION ALL SELECT 'edges', NULL, count(*) FROM edges")
def graph_stats(s, d):
    return lookup.graph_stats(_n(s, d), _e(s, d))


def _recursive(here: str, there: str) -> str:
    return f"""WITH RECURSIVE {BOTH}, walk AS (
  SELECT {there} AS id, 0 AS level FROM edges WHERE {here} = 'customer:7' AND type = 'calls'
  UNION ALL SELECT e.{there}, w.level + 1 FROM walk w JOIN edges e ON e.{here} = w.id WHERE e.type = 'calls' AND w.level < 2)
SELECT DISTINCT n.id, n.name, w.level FROM walk w JOIN nodes n ON n.id = w.id"""


@query(_recursive("target", "source"))
def callers_sql_depth3(s, d):
    return lookup.calls_within(s, _n(s, d), _e(s, d), "customer:7", 3).select("id", "name", "level")


@query(_recursive("source", "target").replace("customer:7", "order:7"))
def callees_sql_depth3(s, d):
    return lookup.calls_within(s, _n(s, d), _e(s, d), "order:7", 3, callees=True).select("id", "name", "level")


# traversals


def _walks(start: str, depth: int, where: str = "TRUE", here: str = "source", there: str = "target") -> str:
    return f"""WITH RECURSIVE {EDGES}, walk AS (
  SELECT '{start}' AS id, 0 AS depth, []::BIGINT[] AS trail, '' AS edge_type
  UNION ALL SELECT e.{there}, w.depth + 1, list_append(w.trail, e.ord), e.type FROM walk w JOIN edges e ON e.{here} = w.id WHERE w.depth < {depth} AND {where}),
best AS (SELECT id, min(depth) AS depth FROM walk WHERE id <> '{start}' GROUP BY id),
found AS (SELECT w.id, w.depth, arg_min(w.edge_type, w.trail) AS edge_type FROM walk w JOIN best b ON b.id = w.id AND b.depth = w.depth GROUP BY w.id, w.depth)
"""


@query(_walks("order:7", 3) + "SELECT id, depth, edge_type FROM found")
def bfs_depth3(s, d):
    return graph.bfs(_e(s, d), "order:7", 3).select("id", "depth", "edge_type")


@query(_walks("customer:7", 3, "e.type = 'calls'", "target", "source") + "SELECT id, depth FROM found")
def callers_mem_depth3(s, d):
    return graph.callers(_e(s, d), "customer:7", 3)


@query(_walks("order:7", 3, "e.type = 'calls'") + "SELECT id, depth FROM found")
def callees_mem_depth3(s, d):
    return graph.callees(_e(s, d), "order:7", 3)


@query(_walks("region:1", 2, f"e.type IN {_in(tables.IMPACT_TYPES)}") + "SELECT id, CASE WHEN depth = 1 THEN 'direct' ELSE 'indirect' END AS reach FROM found")
def impact_depth2(s, d):
    return graph.impact(_e(s, d), "region:1", 2)


@query(f"""WITH RECURSIVE {EDGES}, walk AS (SELECT 'order:1' AS id, 0 AS depth UNION SELECT e.target, w.depth + 1 FROM walk w JOIN edges e ON e.source = w.id WHERE w.depth < 60)
SELECT min(depth)::INT AS length FROM walk WHERE id = 'customer:' || (SELECT o_custkey FROM orders WHERE o_orderkey = 1)""")
def shortest_path_length(s, d):
    end = G.table(s, d, "orders").where("o_orderkey = 1").first()["o_custkey"]
    return graph.shortest_path(_e(s, d), "order:1", f"customer:{end}", max_depth=None).agg((F.count("*") - 1).cast("int").alias("length"))


@query()
def shortest_path_nodes(s, d):
    last = G.table(s, d, "orders").where(f"o_custkey = {G.table(s, d, 'orders').where('o_orderkey = 1').first()['o_custkey']}").agg(F.max("o_orderkey")).first()[0]
    return graph.shortest_path(_e(s, d), "order:1", f"order:{last}", max_depth=None)


_KIN = "kin AS (SELECT 'part:' || p_partkey AS source, 'part:' || (p_partkey // 3) AS target, 'inherits' AS type, p_partkey AS ord FROM part WHERE p_partkey > 0)"


def _kin(s, d) -> DataFrame:
    p = G.table(s, d, "part").where("p_partkey > 0")
    return p.select(F.concat(F.lit("part:"), F.col("p_partkey").cast("string")).alias("source"), F.concat(F.lit("part:"), F.floor(F.col("p_partkey") / 3).cast("string")).alias("target"), F.lit("inherits").alias("type"), F.col("p_partkey").alias("ord"))


@query(f"""WITH {_KIN}, ids AS (SELECT source AS id FROM kin UNION SELECT target FROM kin)
SELECT id, coalesce((SELECT string_agg(target, ',' ORDER BY ord) FROM kin WHERE source = id), '') AS parents, coalesce((SELECT string_agg(source, ',' ORDER BY ord) FROM kin WHERE target = id), '') AS children FROM ids""")
def type_hierarchy(s, d):
    return graph.type_hierarchy(_kin(s, d)).select("id", F.array_join("parents", ",").alias("parents"), F.array_join("children", ",").alias("children"))


@query(f"WITH {EDGES} SELECT source AS id, string_agg(target || '/' || type, ',' ORDER BY ord) AS ends FROM edges GROUP BY source")
def adjacency_lists(s, d):
    return graph.adjacency(_e(s, d)).select("id", F.array_join(F.transform("ends", lambda e: F.concat(e["end"], F.lit("/"), e["type"])), ",").alias("ends"))


@query()
def dfs_depth3(s, d):
    return graph.dfs(_e(s, d), "order:7", 3)


@query(f"WITH {NODES} SELECT id FROM nodes")
def kahn_order(s, d):
    return graph.topological_order(_n(s, d), _e(s, d)).select("id")


def _file_nodes(s, d) -> DataFrame:
    return _n(s, d).where("file_path IS NOT NULL").withColumn("type", F.lit("file"))


_LAYER_SQL = "CASE " + " ".join(f"WHEN list_has_any(string_split(lower(file_path), '/'), [{', '.join(repr(w + p) for w in words.split() for p in ('', 's'))}]) THEN '{name}'" for name, words in tables.LAYERS) + f" ELSE '{tables.CORE_LAYER}' END"
_LAYER_ORACLE = f"WITH {NODES} SELECT 'layer:' || replace(lower(layer), ' ', '-') AS id, layer AS name, string_agg(n, ',' ORDER BY ord) AS node_ids FROM (SELECT id AS n, ord, {_LAYER_SQL} AS layer FROM nodes WHERE file_path IS NOT NULL) GROUP BY layer"


@query(_LAYER_ORACLE)
def layer_detect_paths(s, d):
    return layers.detect_layers(_file_nodes(s, d)).select("id", "name", F.array_join("node_ids", ",").alias("node_ids"))


_GIVEN = [
    {"name": "Web", "description": "what the web sees", "filePatterns": ["src/routes", "components/"]},
    {"name": "Domain", "description": "rules", "filePatterns": ["src/services", "src/models", "src/components"]},
    {"name": "Empty", "description": "none", "filePatterns": ["nowhere/"]},
]


@query(f"""WITH {NODES} SELECT name, string_agg(n, ',' ORDER BY ord) AS node_ids FROM (SELECT id AS n, ord, CASE WHEN starts_with(file_path, 'src/routes') OR contains(file_path, '/src/routes') OR starts_with(file_path, 'components/') OR contains(file_path, '/components/') THEN 'Web'
 WHEN starts_with(file_path, 'src/services') OR starts_with(file_path, 'src/models') OR starts_with(file_path, 'src/components') THEN 'Domain' ELSE 'Other' END AS name FROM nodes WHERE file_path IS NOT NULL) GROUP BY name""")
def llm_layers_prefix(s, d):
    return layers.apply_layers(_file_nodes(s, d), _GIVEN).select("name", F.array_join("node_ids", ",").alias("node_ids"))


@query()
def heuristic_tour(s, d):
    nodes = _file_nodes(s, d)
    found = storage.materialize(layers.detect_layers(nodes), "layers")
    return layers.tour(nodes, _e(s, d), found).select("order", "title", F.size("node_ids").alias("n"), F.sha2("description", 256).alias("description"))


@query()
def walkthrough_tour(s, d):
    return layers.tour(_n(s, d).where("type <> 'resource'"), _e(s, d)).select("order", "title", "description", F.array_join("node_ids", ",").alias("node_ids"))


# quality


@query(f"WITH {NODES}, {_DIRTY_NODES} SELECT ord, lower(type) AS type, lower(complexity) AS complexity FROM dirty")
def sanitize_nodes(s, d):
    return quality.sanitize_nodes(G.dirty_nodes(s, d)).select("ord", "type", "complexity")


@query(f"WITH {NODES}, {_DIRTY_NODES} SELECT ord, {_case('lower(type)', tables.NODE_ALIASES, 'lower(type)')} AS type FROM dirty")
def alias_nodes(s, d):
    return quality.alias_nodes(quality.sanitize_nodes(G.dirty_nodes(s, d))).select("ord", "type")


@query(f"WITH {EDGES}, {_DIRTY_EDGES} SELECT ord, lower(direction) AS direction, {_case('lower(type)', tables.EDGE_ALIASES, 'lower(type)')} AS type FROM dirty")
def alias_edges(s, d):
    return quality.alias_edges(quality.sanitize_edges(G.dirty_edges(s, d))).select("ord", "direction", "type")


@query(f"WITH {NODES}, {_FIXED_NODES} SELECT ord, id, type, complexity, summary, array_to_string(tags, ',') AS tags FROM fixed_n")
def autofix_nodes(s, d):
    return quality.fixed_nodes(G.dirty_nodes(s, d)).select("ord", "id", "type", "complexity", "summary", F.array_join("tags", ",").alias("tags"))


@query(f"WITH {EDGES}, {_FIXED_EDGES} SELECT ord, type, direction, weight FROM fixed_e")
def autofix_edges(s, d):
    return quality.fixed_edges(G.dirty_edges(s, d)).select("ord", "type", "direction", "weight")


@query(f"WITH {NODES}, {_FIXED_NODES} SELECT id, type, name, complexity FROM good_n")
def validate_nodes(s, d):
    return quality.valid_nodes(G.dirty_nodes(s, d)).select("id", "type", "name", "complexity")


@query(f"WITH {BOTH}, {_FIXED_NODES}, {_FIXED_EDGES} SELECT source, target, type, direction, weight FROM good_e WHERE source IN (SELECT id FROM good_n) AND target IN (SELECT id FROM good_n)")
def validate_edges(s, d):
    return quality.valid_edges(G.dirty_edges(s, d), quality.valid_nodes(G.dirty_nodes(s, d))).select("source", "target", "type", "direction", "weight")


_LEVELS = f"""
SELECT 'auto-corrected' AS level, 'missing-field' AS category, sum((coalesce(type, '') = '')::INT + (coalesce(complexity, '') = '')::INT + (tags IS NULL)::INT + (coalesce(summary, '') = '')::INT) AS n FROM dirty_n
UNION ALL SELECT 'auto-corrected', 'missing-field', sum((coalesce(type, '') = '')::INT + (coalesce(direction, '') = '')::INT + (weight IS NULL AND weight_text IS NULL)::INT) FROM dirty_e
UNION ALL SELECT 'auto-corrected', 'alias', count(*) FROM dirty_n WHERE lower(complexity) IN {_in(tables.COMPLEXITY_ALIASES)}
UNION ALL SELECT 'auto-corrected', 'alias', count(*) FROM dirty_e WHERE lower(direction) IN {_in(tables.DIRECTION_ALIASES)}
UNION ALL SELECT 'auto-corrected', 'type-coercion', count(*) FROM dirty_e WHERE weight IS NULL AND weight_text IS NOT NULL
UNION ALL SELECT 'auto-corrected', 'out-of-range', count(*) FROM dirty_e WHERE coalesce(weight, TRY_CAST(weight_text AS DOUBLE), 0.5) NOT BETWEEN 0 AND 1
UNION ALL SELECT 'dropped', 'invalid-nodes', (SELECT count(*) FROM fixed_n) - (SELECT count(*) FROM good_n)
UNION ALL SELECT 'dropped', 'invalid-edges', (SELECT count(*) FROM fixed_e) - (SELECT count(*) FROM good_e)
UNION ALL SELECT 'dropped', 'invalid-reference', count(*) FROM good_e WHERE source NOT IN (SELECT id FROM good_n) OR target NOT IN (SELECT id FROM good_n)"""


@query(f"WITH {BOTH}, {_FIXED_NODES}, {_FIXED_EDGES}, each AS ({_LEVELS}) SELECT level, category, sum(n)::BIGINT AS n FROM each GROUP BY level, category")
def dq_issues(s, d):
    return quality.issues_of(G.dirty_nodes(s, d), G.dirty_edges(s, d)).groupBy("level", "category").agg(F.count("*").alias("n"))


@query(f"WITH {BOTH}, {_DIRTY_EDGES} SELECT source, target, 'target' AS missing FROM dirty WHERE target NOT IN (SELECT id FROM nodes)")
def dangling_edges(s, d):
    return quality.checked_ends(G.dirty_edges(s, d), _n(s, d)).where("missing IS NOT NULL").select("source", "target", "missing")


_REAL = "(CASE type WHEN 'function' THEN 'func' ELSE type END || ':' || coalesce(file_path, name))"
_MESSY = f"messy AS (SELECT ord, type, name, file_path, {_REAL} AS real_id, CASE ord % 6 WHEN 0 THEN 'my-project:' || {_REAL} WHEN 1 THEN 'file:' || {_REAL} WHEN 2 THEN coalesce(file_path, name) WHEN 3 THEN '  ' || {_REAL} || ' ' WHEN 4 THEN ':' || name ELSE {_REAL} END AS id FROM nodes)"


@query(f"""WITH {NODES}, {_MESSY}, prefixed AS (SELECT *, CASE type WHEN 'function' THEN 'func' ELSE type END AS prefix FROM messy)
SELECT ord, CASE WHEN ord % 6 NOT IN (2, 4) THEN real_id WHEN type IN ('function', 'class') AND coalesce(file_path, '') <> '' THEN prefix || ':' || file_path || ':' || name ELSE prefix || ':' || id END AS id FROM prefixed""")
def normalize_ids(s, d):
    m = G.messy_ids(s, d)
    return m.select("ord", C.canonical_id(F.col("id"), F.col("type"), F.col("file_path"), F.col("name"), F.lit(None).cast("string")).alias("id"))


@query(f"""WITH {NODES}, raw AS (SELECT ord, CASE ord % 6 WHEN 0 THEN ' Low ' WHEN 1 THEN 'advanced' WHEN 2 THEN '2' WHEN 3 THEN '7.5' WHEN 4 THEN '0' ELSE complexity END AS c FROM nodes)
SELECT ord, CASE ord % 6 WHEN 0 THEN 'simple' WHEN 1 THEN 'complex' WHEN 2 THEN 'simple' WHEN 3 THEN 'complex' WHEN 4 THEN 'moderate' ELSE c END AS complexity FROM raw""")
def normalize_complexity(s, d):
    o = F.col("ord")
    raw = F.when(o % 6 == 0, " Low ").when(o % 6 == 1, "advanced").when(o % 6 == 2, "2").when(o % 6 == 3, "7.5").when(o % 6 == 4, "0").otherwise(F.col("complexity"))
    number = F.expr("try_cast(raw AS double)")
    return _n(s, d).select("ord", raw.alias("raw")).select("ord", C.canonical_complexity(F.when(number.isNull(), F.col("raw")), number).alias("complexity"))


def _batch(s, d) -> quality.Batch:
    """Nodes and edges whose ids have a project's name before them, with some edges to nowhere and some twice."""
    pre = {"region": "domain", "nation": "module", "customer": "service", "supplier": "resource", "part": "class", "order": "func"}

    def real(col: str):
        return F.concat(C.mapped(F.substring_index(col, ":", 1), pre), F.lit(":"), F.substring_index(col, ":", -1))

    nodes = _n(s, d).select("ord", F.concat(F.lit("shop:"), real("id")).alias("id"), "type", "name", "file_path", F.when(F.col("ord") % 4 == 0, "5").otherwise(F.col("complexity")).alias("complexity"))
    e = _e(s, d)
    edges = e.select("ord", F.concat(F.lit("shop:"), real("source")).alias("source"), F.when(F.col("ord") % 17 == 0, F.concat(F.lit("ghost:"), F.col("ord").cast("string"))).when(F.col("ord") % 3 == 0, real("target")).otherwise(F.concat(F.lit("shop:"), real("target"))).alias("target"), "type")
    twice = edges.where("ord % 5 = 0").withColumn("ord", F.col("ord") + 20 * BAND)
    return quality.normalize_batch(nodes, edges.union(twice))


_SHORT = "CASE split_part(%s, ':', 1) WHEN 'region' THEN 'domain' WHEN 'nation' THEN 'module' WHEN 'customer' THEN 'service' WHEN 'supplier' THEN 'resource' WHEN 'part' THEN 'class' ELSE 'func' END || ':' || split_part(%s, ':', 2)"
_S, _T = _SHORT.replace("%s", "source"), _SHORT.replace("%s", "target")


@query(f"WITH {EDGES} SELECT {_S} AS source, {_T} AS target, type FROM edges WHERE ord % 17 <> 0")
def normalize_batch_edges(s, d):
    return _batch(s, d).edges.select("source", "target", "type")


@query(f"""WITH {BOTH} SELECT (SELECT count(*) FROM nodes) AS ids_fixed, (SELECT count(*) FROM nodes WHERE ord % 4 = 0) AS complexity_fixed,
 (SELECT count(*) + count(*) FILTER (WHERE ord % 5 = 0) FROM edges) AS edges_rewritten, (SELECT count(*) + count(*) FILTER (WHERE ord % 5 = 0) FROM edges WHERE ord % 17 = 0) AS dangling_edges_dropped""")
def normalize_batch_stats(s, d):
    return _batch(s, d).stats


@query(f"WITH {EDGES} SELECT {_S} AS source, 'ghost:' || ord AS target, type, 'missing-target' AS reason FROM edges WHERE ord % 17 = 0")
def normalize_batch_dropped(s, d):
    return _batch(s, d).dropped.select("source", "target", "type", "reason").distinct()


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC, l_partkey DESC, l_suppkey DESC, l_quantity DESC) = 1")
def dedup_last_wins(s, d):
    lines = G.table(s, d, "lineitem").withColumn("ord", F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity"))
    return lookup.last_wins(lines, "l_orderkey").select("l_orderkey", "l_linenumber", "l_quantity")


@query("SELECT l_partkey, l_suppkey, min(l_orderkey * 10 + l_linenumber) AS ord FROM lineitem GROUP BY l_partkey, l_suppkey")
def dedup_first_wins(s, d):
    lines = G.table(s, d, "lineitem").select("l_partkey", "l_suppkey", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"))
    return lookup.first_wins(lines, "l_partkey", "l_suppkey")


# resolution


@query("""WITH sym AS (SELECT p_name AS name, 'lib/' || p_partkey || '.py' AS file, CASE WHEN p_partkey % 3 = 0 THEN 'interface' ELSE 'class' END AS kind, p_partkey AS ord FROM part),
wanted AS (SELECT CASE WHEN p_partkey % 2 = 0 THEN 'class:a' || p_partkey ELSE 'interface:a' || p_partkey END AS source, p_name AS name, CASE WHEN p_partkey % 5 = 0 THEN 'implements' ELSE 'extends' END AS how, p_partkey FROM part),
kinds AS (SELECT *, CASE WHEN how = 'implements' OR starts_with(source, 'interface:') THEN 'interface' ELSE 'class' END AS kind FROM wanted)
SELECT DISTINCT source, kind || ':' || arg_min(s.file, s.ord) || ':' || k.name AS target, CASE how WHEN 'extends' THEN 'inherits' ELSE 'implements' END AS type FROM kinds k JOIN sym s USING (name, kind) GROUP BY source, how, k.name, kind""")
def inheritance_first_match(s, d):
    p, k = G.table(s, d, "part"), F.col("p_partkey")
    sym = p.select(F.col("p_name").alias("name"), F.concat(F.lit("lib/"), k.cast("string"), F.lit(".py")).alias("file"), F.when(k % 3 == 0, "interface").otherwise("class").alias("kind"), k.alias("ord"))
    wanted = p.select(F.concat(F.when(k % 2 == 0, "class:a").otherwise("interface:a"), k.cast("string")).alias("source"), F.col("p_name").alias("parent"), F.when(k % 5 == 0, "implements").otherwise("extends").alias("how"))
    return resolve.inheritance(wanted, sym)


@query("""WITH f AS (SELECT 'src/' || o_custkey % 50 || '/o' || o_orderkey || CASE o_orderkey % 3 WHEN 0 THEN '.ts' WHEN 1 THEN '.py' ELSE '' END AS path FROM orders),
i AS (SELECT DISTINCT 'src/' || o_custkey % 50 || '/main.py' AS file, CASE o_orderkey % 2 WHEN 0 THEN './o' || o_orderkey ELSE '../' || o_custkey % 50 || '/o' || o_orderkey END AS source, 'src/' || o_custkey % 50 || '/o' || o_orderkey AS stem FROM orders)
SELECT i.file, i.source, f.path AS target FROM i JOIN f ON f.path IN (i.stem, i.stem || '.ts', i.stem || '.py')""")
def import_target_priority(s, d):
    o, k = G.table(s, d, "orders"), F.col("o_orderkey")
    c = (F.col("o_custkey") % 50).cast("string")
    stem = F.concat(F.lit("src/"), c, F.lit("/o"), k.cast("string"))
    files = o.select(F.concat(stem, F.when(k % 3 == 0, ".ts").when(k % 3 == 1, ".py").otherwise("")).alias("path"))
    imports = o.select(F.concat(F.lit("src/"), c, F.lit("/main.py")).alias("file"), F.when(k % 2 == 0, F.concat(F.lit("./o"), k.cast("string"))).otherwise(F.concat(F.lit("../"), c, F.lit("/o"), k.cast("string"))).alias("source"))
    return resolve.local_imports(imports, files)


@query("""SELECT DISTINCT 'src/' || o_custkey % 50 || '/main.py' AS file, 'pkg.sub' || o_orderkey AS source, 'pkg/sub' || o_orderkey || CASE WHEN o_orderkey % 2 = 0 THEN '.py' ELSE '/__init__.py' END AS target FROM orders""")
def import_by_language(s, d):
    o, k = G.table(s, d, "orders"), F.col("o_orderkey")
    files = o.select(F.concat(F.lit("pkg/sub"), k.cast("string"), F.when(k % 2 == 0, ".py").otherwise("/__init__.py")).alias("path"))
    imports = o.select(F.concat(F.lit("src/"), (F.col("o_custkey") % 50).cast("string"), F.lit("/main.py")).alias("file"), F.concat(F.lit("pkg.sub"), k.cast("string")).alias("source"), F.lit("python").alias("language"))
    return resolve.imports_to_files(imports, files)


_REFS = """refs AS (SELECT DISTINCT 'src/o' || l_orderkey % 1000 || '.py' AS source_file, CASE l_partkey % 5 WHEN 0 THEN 'shop.part_' || l_partkey WHEN 1 THEN 'PART_' || l_partkey WHEN 2 THEN 'print' ELSE 'part_' || l_partkey END AS symbol FROM lineitem),
syms AS (SELECT 'part_' || p_partkey AS name, 'lib/' || lower(replace(p_brand, '#', '')) || '.py' AS file FROM part)"""


@query(f"WITH {_REFS} SELECT r.source_file, r.symbol, s.file AS target_file, s.name AS target_symbol, 0.95 AS confidence FROM refs r JOIN syms s ON s.name = r.symbol")
def resolve_exact_name(s, d):
    refs = G.references(s, d).where(~C.is_builtin(F.col("symbol"), F.lit("python")))
    found = resolve.by_name(refs, G.symbols(s, d), G.symbols(s, d).select("file", "name", "ord"))
    return found.where("confidence >= 0.95").select("source_file", "symbol", "target_file", "target_symbol", "confidence")


@query(f"""WITH {_REFS}, asked AS (SELECT DISTINCT symbol FROM refs), exact AS (SELECT a.symbol, s.name, CASE WHEN a.symbol = s.name THEN 0.95 ELSE 0.85 END AS confidence FROM asked a JOIN syms s ON s.name = a.symbol OR (contains(a.symbol, '.') AND s.name = split_part(a.symbol, '.', -1)))
SELECT symbol, name, confidence FROM exact UNION ALL SELECT symbol, name, CASE WHEN lower(symbol) = name THEN 0.5 ELSE 0.35 END FROM asked a JOIN syms s ON starts_with(s.name, lower(a.symbol)) WHERE symbol NOT IN (SELECT symbol FROM exact)""")
def resolve_qualified(s, d):
    return resolve.match_names(G.references(s, d), G.symbols(s, d)).select("symbol", "name", "confidence")


@query("""WITH RECURSIVE f AS (SELECT o_custkey, o_orderkey AS k, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS nxt, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn FROM orders),
walk AS (SELECT o_custkey, k AS start, k, 0 AS hops FROM f WHERE rn = 1 UNION ALL SELECT w.o_custkey, w.start, f.nxt, w.hops + 1 FROM walk w JOIN f ON f.k = w.k WHERE f.nxt IS NOT NULL AND w.hops < 8)
SELECT 'S' || o_custkey AS symbol, 'f' || start AS file, 'f' || arg_max(k, hops) AS final_file, max(hops)::INT AS hops FROM walk GROUP BY o_custkey, start""")
def reexport_chain(s, d):
    o = G.table(s, d, "orders")
    file = F.concat(F.lit("f"), F.col("o_orderkey").cast("string"))
    exports = o.select(file.alias("file"), F.concat(F.lit("S"), F.col("o_custkey").cast("string")).alias("name"))
    chain = G.call_chain(s, d)
    links = chain.select(F.concat(F.lit("f"), F.substring_index("source", ":", -1)).alias("file"), F.concat(F.lit("f"), F.substring_index("target", ":", -1)).alias("target"), F.col("ord"))
    wanted = o.groupBy("o_custkey").agg(F.min("o_orderkey").alias("k")).select(F.concat(F.lit("S"), F.col("o_custkey").cast("string")).alias("symbol"), F.concat(F.lit("f"), F.col("k").cast("string")).alias("file"))
    return resolve.trace_reexports(wanted, exports, links)


# files and texts

_FILES = f"files AS (SELECT doc_id, 'src/' || {_pick(G.FOLDERS, 'doc_id')} || '/doc' || doc_id || '.' || {_pick(G.DOC_SUFFIXES, 'doc_id')} AS path, coalesce(text, '') AS content FROM documents)"


@query(f"WITH {_FILES} SELECT path AS file_path, sha256(content) AS sha256 FROM files")
def sha256_fingerprints(s, d):
    return incremental.hashes(G.document_files(s, d))


_N_LINES = "(length(content) - length(replace(content, chr(10), '')) + 1)"


@query(f"WITH {_FILES} SELECT path, CASE WHEN {_N_LINES} <= 50 THEN 'simple' WHEN {_N_LINES} <= 200 THEN 'moderate' ELSE 'complex' END AS complexity FROM files")
def complexity_by_lines(s, d):
    return G.document_files(s, d).select("path", C.complexity_of_text(F.col("content")).alias("complexity"))


@query(f"WITH {_FILES} SELECT path, split_part(path, '/', -1) || ' (' || {_N_LINES} || ' lines)' AS summary FROM files")
def infer_summary(s, d):
    return G.document_files(s, d).select("path", C.summary_of(F.col("path"), F.col("content")).alias("summary"))


@query(f"""WITH {_FILES} SELECT path, CASE WHEN path LIKE '%.md' THEN 'markdown' WHEN path LIKE '%.yaml' THEN 'yaml' WHEN path LIKE '%.sql' THEN 'sql' WHEN path LIKE '%.sh' THEN 'shell' ELSE 'plaintext' END AS language,
 CASE WHEN path LIKE '%.md' OR path LIKE '%.txt' THEN 'document' WHEN path LIKE '%.yaml' THEN 'config' WHEN path LIKE '%.sql' THEN 'schema' ELSE 'pipeline' END AS node_type,
 concat_ws(',', CASE WHEN path LIKE '%.yaml' THEN 'config' END, CASE WHEN path LIKE '%.md' THEN 'documentation' END, CASE WHEN contains(path, 'test') THEN 'test' END) AS tags, 'src' AS top FROM files""")
def file_facts(s, d):
    p = F.col("path")
    return G.document_files(s, d).select("path", C.language_of(p).alias("language"), C.node_type_of(p).alias("node_type"), F.array_join(C.tags_of(p), ",").alias("tags"), C.top_directory(p).alias("top"))


@query(f"WITH {_FILES} SELECT path FROM files WHERE NOT contains(path, '/utils/') AND (path NOT LIKE '%.sh' OR contains(path, '/tests/'))")
def ignore_rules(s, d):
    return ignore.keep(G.document_files(s, d), ignore.spec(["utils/", "*.sh", "!src/tests/*.sh"])).select("path")


def _snap(new: bool) -> str:
    p = "l_partkey % 11"
    return f"""SELECT 'src/d' || l_orderkey % 5 || '/o' || l_orderkey || '.py' AS file_path, l_orderkey % 50 <> 0 AS whole,
  list(struct_pack(name := 'fn_' || l_partkey || CASE WHEN {p} = 4 AND {new} THEN '_v2' ELSE '' END, p2 := CASE WHEN {p} = 3 AND {new} THEN 'extra' ELSE l_linestatus END, p1 := l_returnflag, exported := l_linenumber % 2 = 0, n := (l_quantity * CASE WHEN {p} = 5 AND {new} THEN 3 ELSE 1 END)::INT) ORDER BY l_linenumber, l_partkey, l_returnflag, CASE WHEN {p} = 3 AND {new} THEN 'extra' ELSE l_linestatus END, l_quantity) AS fns
  FROM lineitem WHERE l_orderkey % 7 <> {1 if new else 2} GROUP BY l_orderkey"""


_SNAPS = f"""old AS ({_snap(False)}), new AS ({_snap(True)}), changes AS (
SELECT coalesce(o.file_path, n.file_path) AS file_path, CASE WHEN o.file_path IS NULL THEN 'new' WHEN n.file_path IS NULL THEN 'deleted' WHEN o.fns = n.fns THEN 'unchanged' ELSE 'structural' END AS change_class, o.fns AS ofns, n.fns AS nfns, o.whole AS whole
FROM old o FULL JOIN new n USING (file_path))"""
_COMPARE = f"""WITH {_SNAPS}, named AS (SELECT *, list_transform(ofns, lambda f: f.name) AS onames, list_transform(nfns, lambda f: f.name) AS nnames FROM changes)
SELECT file_path, change_class, CASE WHEN change_class <> 'structural' THEN '' WHEN NOT whole THEN 'bare' ELSE
  array_to_string(list_concat(list_sort(list_distinct(list_filter(nnames, lambda x: NOT list_contains(onames, x)))), list_sort(list_distinct(list_filter(onames, lambda x: NOT list_contains(nnames, x))))), ',') END AS names FROM named"""


@query(_COMPARE)
def fingerprint_compare(s, d):
    found = incremental.compare(G.snapshot(s, d, False), G.snapshot(s, d, True))
    names = F.transform(F.filter("details", lambda x: F.startswith(x, F.lit("new function: ")) | F.startswith(x, F.lit("removed function: "))), lambda x: F.substring_index(x, ": ", -1))
    bare = F.array_contains("details", F.lit("no structural analysis available — conservative classification"))
    return found.select("file_path", "change_class", F.when(bare, "bare").otherwise(F.array_join(names, ",")).alias("names"))


@query()
def fingerprint_details(s, d):
    return incremental.compare(G.snapshot(s, d, False), G.snapshot(s, d, True)).select("file_path", "change_class", F.array_join("details", "; ").alias("details"))


@query(f"""WITH {_SNAPS}, n AS (SELECT count(*) FILTER (WHERE change_class <> 'unchanged') AS c, count(*) FILTER (WHERE change_class IN ('structural', 'new')) AS again, (SELECT count(*) FROM old) AS total FROM changes)
SELECT 'FULL_UPDATE' AS action, TRUE AS rerun_architecture, TRUE AS rerun_tour, again AS files_to_reanalyze, c || ' files have structural changes (' || CASE WHEN c / total > 0.5 THEN '>30 files and >50% of project' ELSE '>30 files' END || ') — full rebuild recommended' AS reason FROM n""")
def classify_update(s, d):
    old = storage.materialize(G.snapshot(s, d, False), "old")
    changes = incremental.compare(old, G.snapshot(s, d, True))
    return incremental.classify_update(changes, old.count(), old)


@query("SELECT 'zone' || o_custkey % 50 AS directory, CASE WHEN o_custkey % 50 >= 40 THEN 'added' ELSE 'removed' END AS change FROM orders WHERE o_custkey % 50 >= 40 OR o_custkey % 50 < 5 GROUP BY 1, 2")
def directory_changes(s, d):
    o, zone = G.table(s, d, "orders"), F.col("o_custkey") % 50
    path = F.concat(F.lit("zone"), zone.cast("string"), F.lit("/o"), F.col("o_orderkey").cast("string"))
    known = o.where(zone < 40).select(path.alias("file_path"))
    changes = o.where((zone >= 40) | (zone < 5)).select(path.alias("file_path"), F.when(zone >= 40, "new").otherwise("deleted").alias("change_class"))
    return incremental.directory_changes(changes, known)


def _merge_input(s, d):
    n, e = _n(s, d), _e(s, d)
    changed = n.where("file_path IS NOT NULL AND ord % 3 = 0").select("file_path")
    back = n.where("type = 'function' AND ord % 2 = 0").join(changed.distinct(), "file_path", "left_semi").select(n.columns)
    fresh = back.select(F.col("id").alias("source"), F.lit("customer:1").alias("target"), F.lit("documents").alias("type"), F.lit("forward").alias("direction"), F.lit(None).cast("string").alias("description"), F.lit(0.5).alias("weight"), (F.col("ord") + 30 * BAND).alias("ord"))
    return n, e, changed, back, fresh


_MERGE = f"""{BOTH}, changed AS (SELECT DISTINCT file_path FROM nodes WHERE file_path IS NOT NULL AND ord % 3 = 0), gone AS (SELECT * FROM nodes WHERE file_path IN (SELECT file_path FROM changed)),
back AS (SELECT * FROM gone WHERE type = 'function' AND ord % 2 = 0), merged AS (SELECT * FROM nodes WHERE id NOT IN (SELECT id FROM gone) UNION ALL SELECT * FROM back)"""


@query(f"WITH {_MERGE} SELECT {_FLAT_SQL} FROM merged")
def merge_graph_nodes(s, d):
    n, _, changed, back, _ = _merge_input(s, d)
    return incremental.merge_nodes(n, changed, back).select(_FLAT)


@query(f"""WITH {_MERGE}, every AS (SELECT source, target, type FROM edges WHERE source NOT IN (SELECT id FROM gone) UNION ALL SELECT id, 'customer:1', 'documents' FROM back)
SELECT source, target, type FROM every WHERE source IN (SELECT id FROM merged) AND target IN (SELECT id FROM merged)""")
def merge_graph_edges(s, d):
    n, e, changed, back, fresh = _merge_input(s, d)
    return incremental.merge_edges(n, e, changed, back, fresh).select("source", "target", "type")


@query("SELECT k, CASE WHEN k % 3 = 0 THEN 'new' ELSE 'old' END AS v FROM (SELECT o_orderkey AS k FROM orders)")
def upsert_keys(s, d):
    o = G.table(s, d, "orders").select(F.col("o_orderkey").alias("k"))
    return lookup.upsert(o.withColumn("v", F.lit("old")), o.where("k % 3 = 0").withColumn("v", F.lit("new")), "k")


# search


def _first_vector(s, d) -> list[float]:
    return [float(x) for x in G.table(s, d, "embeddings").where("vec_id = 0").first()["embedding"]]


_COSINE = "q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0), sims AS (SELECT vec_id, label, least(greatest(list_cosine_similarity(embedding::DOUBLE[], q), 0), 1) AS sim FROM embeddings, q)"


@query(f"WITH {_COSINE} SELECT vec_id, round(sim, 6) AS score FROM sims ORDER BY sim DESC, vec_id LIMIT 20")
def cosine_topk(s, d):
    rows = G.table(s, d, "embeddings").select("vec_id", search.clamped(search.cosine("embedding", _first_vector(s, d))).alias("sim"))
    return rows.orderBy(F.desc("sim"), "vec_id").limit(20).select("vec_id", F.round("sim", 6).alias("score"))


@query(f"WITH {_COSINE} SELECT vec_id, round_even(sim, 4) AS score FROM sims WHERE sim >= 0.2")
def cosine_threshold(s, d):
    return search.by_embedding(G.table(s, d, "embeddings"), _first_vector(s, d), threshold=0.2, limit=0, key="vec_id").select("vec_id", "score")


@query(f"WITH {_COSINE}, {NODES} SELECT n.id, round_even(1 - sim, 4) AS score FROM sims JOIN nodes n ON n.id = 'part:' || vec_id")
def semantic_engine(s, d):
    embedded = G.table(s, d, "embeddings").select(F.concat(F.lit("part:"), F.col("vec_id").cast("string")).alias("node_id"), "embedding")
    return search.semantic(_n(s, d), embedded, _first_vector(s, d), types=["class"], limit=0)


@query(f"""WITH {NODES}, t AS (SELECT id, list_filter(regexp_split_to_array(lower(concat_ws(' ', name, summary, array_to_string(tags, ' '))), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS w FROM nodes),
c AS (SELECT id, len(w) AS l, len(list_filter(w, lambda x: x = 'red')) AS f0, len(list_filter(w, lambda x: x = 'widget')) AS f1 FROM t),
z AS (SELECT count(*) AS n, avg(l) AS m, count(*) FILTER (WHERE f0 > 0) AS d0, count(*) FILTER (WHERE f1 > 0) AS d1 FROM c)
SELECT id, round(-(greatest(ln((n - d0 + 0.5) / (d0 + 0.5)), 1e-6) * f0 * 2.2 / (f0 + 1.2 * (0.25 + 0.75 * l / m)) + greatest(ln((n - d1 + 0.5) / (d1 + 0.5)), 1e-6) * f1 * 2.2 / (f1 + 1.2 * (0.25 + 0.75 * l / m))), 6) AS rank FROM c, z WHERE f0 > 0 AND f1 > 0 ORDER BY round(rank, 9), id LIMIT 20""")
def text_search_bm25(s, d):
    return search.bm25(_n(s, d), "red widget").select("id", F.round("rank", 6).alias("rank"))


@query(f"WITH {NODES} SELECT id, name FROM nodes WHERE name ILIKE '%bolt%' OR summary ILIKE '%bolt%' OR array_to_string(tags, ' ') ILIKE '%bolt%' ORDER BY id LIMIT 20")
def text_search_like(s, d):
    return search.like(_n(s, d), "bolt").select("id", "name")


@query()
def fuzzy_token_sort(s, d):
    return search.fuzzy_nodes(_n(s, d), "widgit red", threshold=60.0, limit=0)


@query()
def fuzzy_engine(s, d):
    return search.fuzzy_engine(_n(s, d), "machinery widgt", limit=0)


# extraction in SQL


@query("""WITH l AS (SELECT page_id, generate_subscripts(a, 1) - 1 AS pos, unnest(a) AS target FROM (SELECT page_id, regexp_extract_all(html, '<a href="([^"]*)"', 1) AS a FROM pages)) SELECT page_id, pos, target, CASE WHEN starts_with(target, 'http') THEN 'external' ELSE 'local' END AS kind FROM l""")
def page_links(s, d):
    links = F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), 1)
    found = G.table(s, d, "pages").select("page_id", F.posexplode(links).alias("pos", "target"))
    return found.select("page_id", F.col("pos").cast("bigint").alias("pos"), "target", F.when(F.startswith(F.col("target"), F.lit("http")), "external").otherwise("local").alias("kind"))


@query("""WITH l AS (SELECT doc_id, generate_subscripts(a, 1) AS line, unnest(a) AS t, len(a) AS n FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS a FROM documents)), h AS (SELECT doc_id, line, n FROM l WHERE length(t) < 30)
SELECT doc_id, line::INT AS line_start, coalesce(lead(line) OVER (PARTITION BY doc_id ORDER BY line) - 1, n)::INT AS line_end FROM h""")
def line_sections(s, d):
    from pyspark.sql import Window

    lines = G.table(s, d, "documents").select("doc_id", F.split(F.coalesce("text", F.lit("")), "\n", -1).alias("a")).select("doc_id", F.size("a").alias("n"), F.posexplode("a").alias("pos", "t"))
    heads = lines.where(F.length("t") < 30).select("doc_id", "n", (F.col("pos") + 1).alias("line_start"))
    ahead = F.lead("line_start").over(Window.partitionBy("doc_id").orderBy("line_start"))
    return heads.select("doc_id", "line_start", F.coalesce(ahead - 1, "n").alias("line_end"))


def _env_files(s, d) -> DataFrame:
    e = G.dealt(G.table(s, d, "events").select("user_id", "event_id", "event_type", "value"), G.DEALT_ROWS, "user_id")
    line = F.concat(F.when(F.col("event_id") % 5 == 0, "# ").otherwise(""), F.upper("event_type"), F.lit("_"), F.col("event_id").cast("string"), F.when(F.col("event_id") % 7 == 0, " = ").otherwise("="), F.col("value").cast("string"))
    rows = F.array_sort(F.collect_list(F.struct("event_id", line.alias("line"))))
    return e.groupBy("user_id").agg(F.array_join(F.transform(rows, lambda r: r["line"]), "\n").alias("content")).select(F.concat(F.lit("conf/u"), F.col("user_id").cast("string"), F.lit(".env")).alias("path"), "content")


@query("""WITH r AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id)::INT AS line FROM events)
SELECT 'conf/u' || user_id || '.env' AS file_path, upper(event_type) || '_' || event_id AS name, line FROM r WHERE event_id % 5 <> 0 AND event_id % 7 <> 0""")
def env_vars(s, d):
    found = registry.analyze(_env_files(s, d), lists=("definitions",)).select("file_path", F.inline("definitions"))
    return found.select("file_path", "name", F.col("line_start").alias("line"))


@query("SELECT 'db/c' || c_custkey || '.sql' AS file_path, 't' || c_custkey AS name, 'table' AS kind, 'id,name' AS fields FROM customer UNION ALL SELECT 'db/c' || c_custkey || '.sql', 'i' || c_custkey, 'index', '' FROM customer")
def sql_definitions(s, d):
    k = F.col("c_custkey").cast("string")
    text = F.concat(F.lit("CREATE TABLE IF NOT EXISTS t"), k, F.lit(" (\n  id INT NOT NULL,\n  name TEXT,\n  PRIMARY KEY (id)\n);\ncreate unique index i"), k, F.lit(" on t (id);\n"))
    files = G.dealt(G.table(s, d, "customer").select("c_custkey"), G.DEALT_KEYS).select(F.concat(F.lit("db/c"), k, F.lit(".sql")).alias("path"), text.alias("content"))
    return registry.analyze(files, lists=("definitions",)).select("file_path", F.inline("definitions")).select("file_path", "name", "kind", F.array_join("fields", ",").alias("fields"))


_PY_PATH = f"'src/' || {_pick(G.FOLDERS, 'o_custkey')} || '/customer' || o_custkey || '.py'"


@query(f"""WITH o AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn FROM orders)
SELECT {_PY_PATH} AS file_path, 'order_' || o_orderkey AS name, (6 + (rn - 1) * 3)::INT AS line_start, (7 + (rn - 1) * 3)::INT AS line_end, 'total,status' AS params, 'str' AS return_type FROM o""")
def python_extract(s, d):
    found = registry.analyze(G.python_files(s, d), lists=("functions",)).select("file_path", F.inline("functions"))
    return found.select("file_path", "name", "line_start", "line_end", F.array_join("params", ",").alias("params"), "return_type")


@query(f"""WITH o AS (SELECT o_custkey, o_orderkey, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS nxt FROM orders)
SELECT {_PY_PATH} AS file_path, 'order_' || o_orderkey AS caller, coalesce('order_' || nxt, 'settle') AS callee FROM o""")
def python_calls(s, d):
    return registry.analyze(G.python_files(s, d), lists=("calls",)).select("file_path", F.inline("calls")).select("file_path", "caller", "callee")


def _whole(s, d) -> DataFrame:
    book = s.createDataFrame([("src/shared/book.py", "def settle(total):\n    return total\n\n\nclass Ledger(Base):\n    rate: int = 1\n\n    def add(self, entry):\n        return settle(entry)\n\n\nclass Base:\n    pass\n"), ("README.md", "# Shop\n\ntext\n"), ("requirements.txt", "fastapi==1.0\n")], "path string, content string")
    return G.python_files(s, d).union(book)


@query(f"""WITH o AS (SELECT {_PY_PATH} AS path, o_custkey, o_orderkey, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS nxt FROM orders), f AS (SELECT DISTINCT path, o_custkey FROM o)
SELECT 'contains' AS type, count(*) + (SELECT count(*) FROM f) + 4 AS n FROM o UNION ALL SELECT 'calls', count(nxt) + count(*) FILTER (WHERE nxt IS NULL) + 1 FROM o UNION ALL SELECT 'imports', count(*) FROM f UNION ALL SELECT 'inherits', 1""")
def pipeline_end_to_end(s, d):
    return project.analyze(_whole(s, d)).edges.groupBy("type").agg(F.count("*").alias("n"))


# replies and concepts


@query("""WITH e AS (SELECT event_id AS reply_id, event_type, user_id, props, CASE WHEN event_id % 3 = 0 THEN 'complex' ELSE 'moderate' END AS c FROM events)
SELECT reply_id, CASE WHEN reply_id % 4 <> 3 THEN event_type END AS file_summary, CASE WHEN reply_id % 4 <> 3 THEN event_type || ',u' || user_id END AS tags, CASE WHEN reply_id % 4 <> 3 THEN c END AS complexity FROM e""")
def llm_json_parse(s, d):
    from codeloom.functions import replies

    found = G.replies(s, d).select("reply_id", replies.file_analysis(F.col("reply")).alias("a"))
    return found.select("reply_id", F.col("a.file_summary").alias("file_summary"), F.array_join("a.tags", ",").alias("tags"), F.col("a.complexity").alias("complexity"))


_CONCEPT_SQL = "concat_ws(',', " + ", ".join(f"CASE WHEN {' OR '.join('contains(t, ' + repr(w.lower()) + ')' for w in words)} THEN '{name}' END" for name, words in tables.CONCEPTS) + ")"


@query(f"WITH {NODES}, x AS (SELECT id, lower(array_to_string(tags, ' ') || ' ' || summary || ' ' || coalesce(language_notes, '')) AS t FROM nodes) SELECT id, {_CONCEPT_SQL} AS concepts FROM x")
def concept_detection(s, d):
    return _n(s, d).select("id", F.array_join(C.concepts_of(F.col("tags"), F.col("summary"), F.col("language_notes")), ",").alias("concepts"))


# events

_GAP = "SELECT *, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap FROM events"


@query(f"SELECT user_id, event_id FROM ({_GAP}) WHERE gap IS NULL OR gap >= INTERVAL 2 HOUR")
def debounce_batch(s, d):
    return streams.debounce(G.table(s, d, "events"), "user_id", 7200).select("user_id", "event_id")


@query(f"SELECT user_id, began, ended, n FROM (SELECT user_id, run, min(ts) AS began, max(ts) AS ended, count(*) AS n FROM (SELECT *, sum(CASE WHEN gap IS NULL OR gap > INTERVAL 2 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM ({_GAP})) GROUP BY user_id, run)")
def session_windows(s, d):
    return streams.sessions(G.table(s, d, "events"), "user_id", 7200)


@query(f"SELECT user_id, event_id FROM ({_GAP}) WHERE gap IS NULL OR gap >= INTERVAL 2 HOUR")
def debounce_stream(s, d):
    path = f"{d}/events.parquet"
    live = s.readStream.schema(s.read.parquet(path).schema).parquet(f"{d}/event[s].parquet")  # a glob: the table may be one file
    return streams.run_to_table(streams.debounce_stream(live, "user_id", 7200), "debounced")
