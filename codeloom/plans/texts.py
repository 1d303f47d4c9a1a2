"""Queries over the rules for names, paths, replies and manifests, by generated texts for each row of a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.extract import plugin_config
from codeloom.functions import columns as C
from codeloom.functions import replies
from codeloom.operators import build, incremental
from codeloom.plans.catalogue import query
from codeloom.sources import testgraph as G

KEY = "c_custkey"


def _customers(s, d) -> DataFrame:
    return G.table(s, d, "customer")


def _key() -> Column:
    return F.col(KEY).cast("string")


def _text(template: str) -> Column:
    return F.replace(F.lit(template), F.lit("@k"), _key())


def _pick(values: list) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.col(KEY) % len(values) + 1).cast("int"))


def _sql_pick(values: list) -> str:
    return "CASE " + " ".join(f"WHEN {KEY} % {len(values)} = {i} THEN " + ("NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v)) for i, v in enumerate(values)) + " END"


#: (file name, language, language of the parser, type of the node)
_FILES = (
    ("main@k.py", "python", "python", "document"),
    ("App@k.tsx", "typescript", "typescript", "document"),
    ("Dockerfile", "dockerfile", "dockerfile", "pipeline"),
    ("conf@k.YAML", "yaml", "yaml", "config"),
    ("schema@k.sql", "sql", "sql", "schema"),
    ("Makefile", "makefile", "makefile", "pipeline"),
    ("infra@k.tf", "terraform", "terraform", "resource"),
    ("notes@k.unknown", None, None, "document"),
)


@query(f"SELECT replace('d' || {KEY} || '/' || {_sql_pick([f[0] for f in _FILES])}, '@k', {KEY}::VARCHAR) AS path, {_sql_pick([f[1] for f in _FILES])} AS language, {_sql_pick([f[2] for f in _FILES])} AS parser, {_sql_pick([f[3] for f in _FILES])} AS type FROM customer")
def languages_by_path(s, d):
    path = F.replace(F.concat(F.lit("d"), _key(), F.lit("/"), _pick([f[0] for f in _FILES])), F.lit("@k"), _key())
    named = _customers(s, d).select(path.alias("path"))
    p = F.col("path")
    return named.select("path", C.language_of(p).alias("language"), C.parser_language_of(p).alias("parser"), C.node_type_of(p).alias("type"))


@query(f"SELECT {KEY} AS key, CASE WHEN {KEY} % 12 <= 2 THEN 'simple' WHEN {KEY} % 12 <= 8 THEN 'moderate' ELSE 'complex' END AS complexity FROM customer")
def complexity_by_symbols(s, d):
    return _customers(s, d).select(F.col(KEY).alias("key"), C.complexity_of_symbols(F.col(KEY) % 12).alias("complexity"))


@query(f"SELECT {KEY} AS key, {_sql_pick(['run', 'run', None, 'load', None])} AS name FROM customer")
def call_names(s, d):
    known = F.array(F.lit("run"), F.lit("load"))
    return _customers(s, d).select(F.col(KEY).alias("key"), C.call_name(_pick(["run", "self.run", "stop", "a.b.load", "run.stop"]), known).alias("name"))


@query(f"SELECT {KEY} AS key, {_sql_pick(['Python', 'TypeScript', 'C++', 'Zig'])} AS name FROM customer")
def display_names(s, d):
    return _customers(s, d).select(F.col(KEY).alias("key"), C.display_name(_pick(["python", "typescript", "cpp", "zIG"])).alias("name"))


@query(f"""WITH c AS (SELECT c_nationkey, count(*) FILTER (WHERE {KEY} % 5 = 0) AS a, count(*) FILTER (WHERE {KEY} % 5 = 1) AS b, count(*) FILTER (WHERE {KEY} % 5 = 2) AS m FROM customer GROUP BY 1)
SELECT c_nationkey AS nation, concat_ws(', ', CASE WHEN a > 0 THEN a || ' new' END, CASE WHEN b > 0 THEN b || ' deleted' END, CASE WHEN m > 0 THEN m || ' modified' END) AS said FROM c""")
def change_summary(s, d):
    kinds = [F.count_if(F.col(KEY) % 5 == i).alias(name) for i, name in enumerate(("new", "deleted", "structural"))]
    return _customers(s, d).groupBy(F.col("c_nationkey").alias("nation")).agg(*kinds).select("nation", incremental.summary_of_changes().alias("said"))


@query(f"SELECT {KEY} AS key, least({KEY} % 80, 50) AS told FROM customer")
def tour_prompt_edges(s, d):
    """A prompt for a tour names the first fifty edges."""
    edges = F.transform(F.slice(F.sequence(F.lit(0), F.lit(99)), 1, (F.col(KEY) % 80).cast("int")), lambda i: F.concat(F.lit("edge "), i.cast("string")))
    none = F.array(F.lit("x"))
    prompt = replies.tour_prompt(none, edges, none)
    return _customers(s, d).select(F.col(KEY).alias("key"), F.size(F.regexp_extract_all(prompt, F.lit(r"(edge \d+)"), 1)).cast("bigint").alias("told"))


@query(f"SELECT {KEY} AS key, CASE WHEN {KEY} % 3 <> 2 THEN 'about ' || {KEY} END AS description, CASE WHEN {KEY} % 3 = 0 THEN 'react,c' || {KEY} WHEN {KEY} % 3 = 1 THEN '' END AS frameworks, CASE WHEN {KEY} % 3 = 0 THEN 'L' || {KEY} WHEN {KEY} % 3 = 1 THEN '' END AS layers FROM customer")
def project_replies(s, d):
    whole = '```json\n{"description": "about @k", "frameworks": ["react", 3, "c@k"], "layers": [{"name": "L@k", "description": "x", "filePatterns": ["p"]}, {"no": 1}]}\n```'
    reply = F.replace(_pick([whole, 'so: {"description": "about @k"} .', "nothing @k"]), F.lit("@k"), _key())
    found = _customers(s, d).select(F.col(KEY).alias("key"), replies.project_summary(reply).alias("p"))
    return found.select("key", "p.description", F.array_join("p.frameworks", ",").alias("frameworks"), F.array_join(F.transform("p.layers", lambda x: x["name"]), ",").alias("layers"))


@query(f'SELECT {KEY} AS key, {KEY}::INT AS "order", \'T\' || {KEY} AS title, \'n\' || {KEY} AS node_ids, CASE WHEN {KEY} % 2 = 0 THEN \'why\' END AS language_lesson FROM customer')
def tour_replies(s, d):
    steps = '{"steps": [{"order": @k, "title": "T@k", "description": "d", "nodeIds": ["n@k", 1]%s}, {"order": "1", "title": "x", "description": "d", "nodeIds": ["n"]}, {"order": 2, "title": "", "description": "d", "nodeIds": ["n"]}, {"order": 3, "title": "y", "description": "d", "nodeIds": []}]}'
    reply = F.replace(_pick([steps % ', "languageLesson": "why"', steps % ""]), F.lit("@k"), _key())
    found = _customers(s, d).select(F.col(KEY).alias("key"), F.inline(replies.tour_steps(reply)))
    return found.select("key", "order", "title", F.array_join("node_ids", ",").alias("node_ids"), "language_lesson")


@query(f"SELECT {KEY} AS key, CASE WHEN {KEY} % 2 = 0 THEN 'notes ' || {KEY} ELSE '' END AS language_notes, CASE WHEN {KEY} % 2 = 0 THEN 'loops' ELSE '' END AS concepts FROM customer")
def lesson_replies(s, d):
    whole = '{"languageNotes": "notes @k", "concepts": [{"name": "loops", "explanation": "e"}, {"name": "half"}]}'
    reply = F.replace(_pick([whole, "broken {@k"]), F.lit("@k"), _key())
    found = _customers(s, d).select(F.col(KEY).alias("key"), replies.language_lesson(reply).alias("r"))
    return found.select("key", "r.language_notes", F.array_join(F.transform("r.concepts", lambda x: x["name"]), ",").alias("concepts"))


# frameworks and manifests

_MANIFESTS = [
    ("a/requirements.txt", "Django>=4\nnumpy==1.0\n"),
    ("b/package.json", '{"dependencies": {"react": "18", "express": "4"}}'),
    ("c/pom.xml", "<dependency>spring-boot-starter</dependency>"),
    ("c/go.mod", "module x\nrequire github.com/gin-gonic/gin v1.9\n"),
    ("src/a.py", "import fastapi\n"),
]


@query("SELECT unnest(['react', 'express', 'django', 'spring', 'gin']) AS id")
def frameworks_in_manifests(s, d):
    found = build.used_frameworks(s.createDataFrame(_MANIFESTS, "path string, content string"))
    return s.createDataFrame([(x,) for x in found], "id string")


_ROUTES = [
    ("api@k.py", '@app.get("/items/@k")\nasync def read_item(k):\n    return k\n', "endpoint", "GET /items/@k", "read_item"),
    ("urls@k.py", "urlpatterns = [\n    path('shop/@k', show_shop),\n]\n", "endpoint", "shop/@k", "show_shop"),
    ("Shop@k.java", '@RestController\nclass Shop {\n  @PostMapping("/orders/@k")\n  public Order place(Order o) { return o; }\n}\n', "endpoint", "POST /orders/@k", "place"),
    ("Page@k.tsx", "export function Page@k() {\n  return 1;\n}\n", "function", "Page@k", "Page@k"),
]


@query(f"SELECT replace({_sql_pick([r[0] for r in _ROUTES])}, '@k', {KEY}::VARCHAR) AS file_path, {_sql_pick([r[2] for r in _ROUTES])} AS type, replace({_sql_pick([r[3] for r in _ROUTES])}, '@k', {KEY}::VARCHAR) AS name FROM customer")
def framework_nodes(s, d):
    return build.framework_rows(_route_files(s, d), ["fastapi", "django", "spring", "react"])[0].select("file_path", "type", "name")


@query(f"""WITH r AS (SELECT {KEY} % 4 AS m, replace({_sql_pick([r[0] for r in _ROUTES])}, '@k', {KEY}::VARCHAR) AS p, replace({_sql_pick([r[3] for r in _ROUTES])}, '@k', {KEY}::VARCHAR) AS n, replace({_sql_pick([r[4] for r in _ROUTES])}, '@k', {KEY}::VARCHAR) AS h FROM customer)
SELECT CASE WHEN m = 3 THEN 'file:' || p ELSE 'endpoint:' || p || ':' || n END AS source, 'function:' || p || ':' || h AS target, CASE WHEN m = 3 THEN 'contains' ELSE 'references' END AS type FROM r""")
def framework_edges(s, d):
    return build.framework_rows(_route_files(s, d), ["fastapi", "django", "spring", "react"])[1].select("source", "target", "type")


def _route_files(s, d) -> DataFrame:
    path, text = _pick([r[0] for r in _ROUTES]), _pick([r[1] for r in _ROUTES])
    return _customers(s, d).select(F.replace(path, F.lit("@k"), _key()).alias("path"), F.replace(text, F.lit("@k"), _key()).alias("content"))


@query("SELECT 'shop' AS name, 'java,python,sql' AS languages, 'react' AS frameworks, 'abc' AS git_commit_hash FROM region WHERE r_regionkey = 0")
def project_rows(s, d):
    paths = ["src/a@k.py", "src/B@k.java", "db/c@k.sql", "x/y@k.zzz"]
    nodes = _customers(s, d).select(F.replace(_pick(paths), F.lit("@k"), _key()).alias("file_path"))
    row = build.project_row(nodes, "shop", ["react"], "abc", "2020-01-01T00:00:00")
    return row.select("name", F.array_join("languages", ",").alias("languages"), F.array_join("frameworks", ",").alias("frameworks"), "git_commit_hash")


_CONFIG = '{"plugins": [{"name": "sql", "languages": ["sql", 3]}, {"name": "python", "languages": ["python"], "enabled": false, "options": {"x": 1}}, {"name": "", "languages": ["y"]}, {"name": "none", "languages": []}, 7, {"name": "toml", "languages": ["toml"], "enabled": "no"}]}'


@query("SELECT * FROM (VALUES ('sql', 'sql', true, false), ('python', 'python', false, true), ('toml', 'toml', true, false)) t(name, languages, enabled, options)")
def plugin_configuration(s, d):
    """What a configuration says, after it was written and read again."""
    config = plugin_config.parse(plugin_config.serialize(plugin_config.parse(_CONFIG)))
    return s.createDataFrame([(e.name, ",".join(e.languages), e.enabled, e.options is not None) for e in config.plugins], "name string, languages string, enabled boolean, options boolean")
