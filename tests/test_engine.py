"""What SQL does not say: order of walks, tours, similarity, batches, storage, ignore rules, sync, streams."""

from __future__ import annotations

import random
import uuid
from collections import deque

import pytest
from conftest import SF
from pyspark.sql import functions as F

from codeloom import cli, storage
from codeloom.extract import registry
from codeloom.functions import columns as C
from codeloom.functions import replies, similarity
from codeloom.operators import build, graph, incremental, layers, quality, resolve, search
from codeloom.plans import project
from codeloom.sources import files as file_source
from codeloom.sources import ignore
from codeloom.sources.store import Store
from codeloom.streaming import sync


def edges_of(spark, links, kind="calls"):
    return spark.createDataFrame([(a, b, kind, float(k), k) for k, (a, b) in enumerate(links)], "source string, target string, type string, weight double, ord bigint")


def nodes_of(spark, ids, kinds=None):
    return spark.createDataFrame([(i, (kinds or {}).get(i, "file"), i.upper(), f"s{i}", None, k) for k, i in enumerate(ids)], "id string, type string, name string, summary string, file_path string, ord bigint")


@pytest.fixture(scope="module")
def tangle():
    rng = random.Random(4)
    ids = [f"n{k}" for k in range(14)]
    return ids, [(rng.choice(ids), rng.choice(ids)) for _ in range(30)]


def test_walks_in_order(spark, tangle):
    ids, links = tangle
    out = {}
    for a, b in links:
        out.setdefault(a, []).append(b)
    seen, order, queue = {"n0"}, [], deque([("n0", 0)])
    while queue:
        x, d = queue.popleft()
        if x != "n0":
            order.append((x, d))
        if d < 3:
            for y in out.get(x, []):
                if y not in seen:
                    seen.add(y)
                    queue.append((y, d + 1))
    got = graph.bfs(edges_of(spark, links), "n0", 3).orderBy("depth", "trail").collect()
    assert [(r["id"], r["depth"]) for r in got] == order
    seen, walk = {"n0"}, []

    def go(x, d):
        if d > 3:
            return
        if x != "n0":
            walk.append((x, d))
        for y in out.get(x, []):
            if y not in seen:
                seen.add(y)
                go(y, d + 1)

    go("n0", 0)
    assert [(r["id"], r["depth"]) for r in graph.dfs(edges_of(spark, links), "n0", 3).orderBy("place").collect()] == walk


def test_topological_order_both_ways(spark, tangle):
    ids, links = tangle
    acyclic = [(a, b) for a, b in links if a != b and int(a[1:]) < int(b[1:])] + [("n12", "n13"), ("n13", "n12")]
    n, e = nodes_of(spark, ids), edges_of(spark, acyclic)
    waits = dict.fromkeys(ids, 0)
    for _, b in acyclic:
        waits[b] += 1
    queue, want = deque(i for i in ids if not waits[i]), []
    while queue:
        want.append(queue.popleft())
        for a, b in acyclic:
            if a == want[-1]:
                waits[b] -= 1
                if not waits[b]:
                    queue.append(b)
    want += [i for i in ids if i not in want]
    for limit in (1000, 0):
        got = graph.topological_order(n, e, one_task=limit).collect()
        assert [r["id"] for r in sorted(got, key=lambda r: (r["layer"] is None, r["layer"] or 0, list(r["trail"])))] == want


def test_tour(spark):
    n = nodes_of(spark, list("abcdx"), {"x": "concept"})
    e = edges_of(spark, [("a", "b"), ("b", "c"), ("c", "d"), ("a", "x")])
    steps = layers.tour(n, e).orderBy("order").collect()
    assert [(s["order"], s["title"], s["node_ids"]) for s in steps] == [(1, "Step 1: Code Walkthrough", ["a", "b", "c"]), (2, "Step 2: Code Walkthrough", ["d"]), (3, "Key Concepts", ["x"])]
    assert steps[0]["description"] == "Exploring: A (sa); B (sb); C (sc)."
    made = spark.createDataFrame([("layer:two", "Two", "second", ["c", "d"], 0), ("layer:one", "One", "first", ["b"], 1)], "id string, name string, description string, node_ids array<string>, first_ord bigint")
    steps = layers.tour(n, e, made).orderBy("order").collect()
    assert [(s["title"], s["node_ids"]) for s in steps] == [("One", ["b"]), ("Two", ["c", "d"]), ("Supporting Components", ["a"]), ("Key Concepts", ["x"])]
    assert steps[1]["description"] == "second. Key files: C, D."


def test_paths(spark):
    e = edges_of(spark, [("a", "b"), ("b", "c"), ("a", "d"), ("d", "c"), ("c", "a")])
    path = [r["id"] for r in graph.shortest_path(e, "a", "c").orderBy("step").collect()]
    assert path == ["a", "b", "c"]
    assert [r["id"] for r in graph.shortest_path(e, "a", "a").collect()] == ["a"]
    assert graph.shortest_path(e, "a", "zzz").collect() == []
    assert {(r["id"], r["reach"]) for r in graph.impact(e, "a").collect()} == {("b", "direct"), ("d", "direct"), ("c", "indirect")}


def test_similarity():
    assert similarity.lcs("kitten", "sitting") == 4 and similarity.ratio("", "") == 100
    assert similarity.token_sort_ratio("b a", "a b") == 100 and similarity.partial_ratio("abc", "xxabcxx") == 100
    rng = random.Random(1)
    for _ in range(100):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randint(0, 9))) for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert similarity.lcs(a, b) == table[-1][-1]


def test_search(spark):
    n = spark.createDataFrame([("1", "function", "parseFile", "reads a file", ["io", "parser"], None, 0), ("2", "class", "FileParser", "", [], "file parsing notes", 1), ("3", "function", "other", "nothing", None, None, 2)], "id string, type string, name string, summary string, tags array<string>, language_notes string, ord bigint")
    assert [r["id"] for r in search.fuzzy_engine(n, "parser").collect()][0] in ("1", "2")
    assert search.fuzzy_engine(n, "   ").collect() == [] and search.fuzzy_engine(n, "x").collect() == []
    got = {r["id"]: r for r in search.fuzzy_nodes(n, "parsefile").collect()}
    assert got["1"]["score"] == 200.0 and got["1"]["key"] == "name" and "3" not in got
    assert [r["id"] for r in search.fuzzy_engine(n, "parser", types=["class"]).collect()] == ["2"]
    assert {r["id"] for r in search.text_search(n, "file OR nothing").collect()} == {"1", "3"}
    assert [r["id"] for r in search.text_search(n, "arseFi").collect()] == ["1"]
    assert [r["id"] for r in search.bm25(n, "pars*").collect()][:1] == ["1"]


def test_embeddings(spark):
    rows = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.6, 0.8]), (2, [0.0, 0.0]), (3, [-1.0, 0.0])], "ord bigint, embedding array<double>")
    assert [(r["ord"], r["score"]) for r in search.by_embedding(rows, [2.0, 0.0]).collect()] == [(0, 1.0), (1, 0.6)]
    raw = {r["ord"]: r["c"] for r in rows.select("ord", search.cosine("embedding", [2.0, 0.0]).alias("c")).collect()}
    assert raw == {0: 1.0, 1: 0.6, 2: 0.0, 3: -1.0}
    with pytest.raises(Exception, match="dimensions"):
        rows.select(search.cosine("embedding", [1.0]).alias("c")).collect()


def test_canonical_ids(spark):
    cases = [
        ("my-project:file:src/bad.ts", "file", None, None, None, "file:src/bad.ts"),
        ("src/bare.ts", "file", None, None, None, "file:src/bare.ts"),
        ("file:file:src/x.ts", "file", None, None, None, "file:src/x.ts"),
        ("run", "function", "a.py", "run", None, "func:a.py:run"),
        ("run", "function", None, "run", None, "func:run"),
        ("step:checkout:pay", "step", "a.py", None, None, "step:checkout:a.py:pay"),
        ("Pay Now", "step", "a.py", None, "checkout", "step:checkout:a.py:pay-now"),
        ("  ", "file", None, None, None, ""),
        (":x", "file", None, None, None, "file::x"),
        ("x:", "weird", None, None, None, "x:"),
        ("function:a:b", "function", "a", "b", None, "func:a:b"),
    ]
    df = spark.createDataFrame(cases, "raw string, type string, path string, name string, flow string, want string")
    ids = C.canonical_id(F.col("raw"), F.col("type"), F.col("path"), F.col("name"), F.col("flow"))
    for r in df.select("raw", "want", ids.alias("got")).collect():
        assert r["got"] == r["want"], r


def test_batch(spark):
    n = spark.createDataFrame([("file:src/good.ts", "file", "good", "src/good.ts", "simple", 0), ("my-project:file:src/bad.ts", "file", "bad", "src/bad.ts", "HIGH", 1), ("src/bare.ts", "file", "bare", "src/bare.ts", "4", 2), ("file:src/bare.ts", "file", "again", "src/bare.ts", "complex", 3)], "id string, type string, name string, file_path string, complexity string, ord bigint")
    e = spark.createDataFrame([("my-project:file:src/bad.ts", "src/bare.ts", "imports", 0), ("file:src/bad.ts", "file:src/bare.ts", "imports", 1), ("other:file:src/good.ts", "file:src/bad.ts", "calls", 2), ("nope", "file:src/bad.ts", "calls", 3), ("nope", "gone", "calls", 4)], "source string, target string, type string, ord bigint")
    done = quality.normalize_batch(n, e)
    assert {(r["id"], r["name"], r["complexity"]) for r in done.nodes.collect()} == {("file:src/good.ts", "good", "simple"), ("file:src/bad.ts", "bad", "complex"), ("file:src/bare.ts", "again", "complex")}
    assert {(r["source"], r["target"], r["type"], r["ord"]) for r in done.edges.collect()} == {("file:src/bad.ts", "file:src/bare.ts", "imports", 0), ("file:src/good.ts", "file:src/bad.ts", "calls", 2)}
    assert sorted(r["reason"] for r in done.dropped.collect()) == ["missing-both", "missing-source"]
    assert done.stats.first().asDict() == {"ids_fixed": 2, "complexity_fixed": 2, "edges_rewritten": 2, "dangling_edges_dropped": 2}


def test_validation_without_nodes(spark):
    n = spark.createDataFrame([(0, None, "file", None, None, "", None, "simple", None)], "ord bigint, id string, type string, name string, file_path string, summary string, tags array<string>, complexity string, language_notes string")
    e = spark.createDataFrame([], "ord bigint, source string, target string, type string, direction string, description string, weight double, weight_text string")
    done = quality.validate(n, e)
    assert not done.success and done.errors().first()[0] == "No valid nodes found in knowledge graph"


def test_ignore_rules(spark, tmp_path):
    (tmp_path / ".gitignore").write_text("# c\n*.log\n/only/top.txt\nbuild/\n")
    (tmp_path / ignore.OWN_FILE).write_text("!keep.log\n**/deep/*.md\n")
    (tmp_path / "tests").mkdir()
    paths = ["a.log", "x/keep.log", "only/top.txt", "x/only/top.txt", "build/a.py", "src/deep/a.md", "src/deep/x/a.md", "node_modules/x/y.js", "src/main.py", "a/LICENSE", "img.png", "vendor", "vendor/x.c"]
    rules = ignore.load_spec(tmp_path)
    kept = [r["path"] for r in ignore.keep(spark.createDataFrame([(p,) for p in paths], "path string"), rules).collect()]
    assert kept == ["x/keep.log", "x/only/top.txt", "src/deep/x/a.md", "src/main.py", "vendor"]
    assert "# tests/" in ignore.starter_text(tmp_path) and "# /only/top.txt" in ignore.starter_text(tmp_path) and "# build" not in ignore.starter_text(tmp_path)
    assert ignore.suggested_rules(["python"], ["django"], ["big.json"])[0] == "*.egg-info"
    before = (tmp_path / ignore.OWN_FILE).read_text()
    ignore.write_ignore_file(tmp_path, languages=["go"])
    assert (tmp_path / ignore.OWN_FILE).read_text() == before


def test_replies(spark):
    text = ['x\n```json\n{"description": "d", "frameworks": ["a", 1], "layers": [{"name": "L", "filePatterns": ["p", 2]}, {"no": 1}]}\n```', "broken {", '[{"name": "A"}, 3]', '{"steps": [{"order": 1, "title": "t", "description": "d", "nodeIds": ["n", 1]}, {"order": 2, "title": "", "description": "d", "nodeIds": ["n"]}]}', '{"languageNotes": 3, "concepts": [{"name": "n", "explanation": "e"}, {"name": "x"}]}']
    df = spark.createDataFrame(list(enumerate(text)), "i int, r string")
    r = F.col("r")
    got = {x["i"]: x for x in df.select("i", replies.project_summary(r).alias("p"), replies.layer_list(r).alias("l"), replies.tour_steps(r).alias("t"), replies.language_lesson(r).alias("c"), replies.file_analysis(r).alias("f")).collect()}
    assert got[0]["p"]["frameworks"] == ["a"] and [(x["name"], x["file_patterns"]) for x in got[0]["p"]["layers"]] == [("L", ["p"])]
    assert got[1]["p"] is None and got[1]["f"] is None and got[1]["t"] == [] and got[1]["c"]["language_notes"] == ""
    assert [x["name"] for x in got[2]["l"]] == ["A"] and got[1]["l"] is None
    assert [(x["order"], x["node_ids"]) for x in got[3]["t"]] == [(1, ["n"])]
    assert [x["name"] for x in got[4]["c"]["concepts"]] == ["n"] and got[3]["f"]["complexity"] == "moderate"


FILES = [
    ("src/__init__.py", ""),
    ("src/main.py", "from src.utils import helper\n\ndef run(x):\n    return helper(x)\n\ndef stop():\n    return run(1)\n\nclass App(Base):\n    def go(self):\n        return run(2)\n"),
    ("src/utils.py", "def helper(x):\n    return len(x)\n\nclass Base:\n    pass\n"),
    ("web/index.ts", "import { greet } from './utils';\ngreet('x');\nexport function start() { return greet('y'); }\n"),
    ("web/utils.ts", "export function greet(n: string) { return n; }\nexport function bye() { return greet('z'); }\n"),
    ("schema.sql", "CREATE TABLE users (\n id INT\n);\nCREATE TABLE posts (\n id INT\n);\n"),
    ("Dockerfile", "FROM python:3\nEXPOSE 80\n"),
    ("README.md", "# Title\n"),
    ("package.json", '{"dependencies": {"react": "1"}}'),
]


def test_project_end_to_end(spark):
    made = project.analyze(spark.createDataFrame(FILES, "path string, content string"), "demo")
    kinds = {r["type"]: r["count"] for r in made.nodes.groupBy("type").count().collect()}
    assert kinds["file"] == 4 and kinds["table"] == 2 and kinds["service"] == 1 and kinds["class"] == 2 and kinds["function"] == 7
    have = {(r["source"], r["target"], r["type"]) for r in made.edges.collect()}
    for want in (("file:web/index.ts", "file:web/utils.ts", "imports"), ("file:src/main.py", "file:src/utils.py", "imports"), ("function:src/main.py:stop", "function:src/main.py:run", "calls"), ("function:src/main.py:run", "function:src/utils.py:helper", "calls"), ("class:src/main.py:App", "class:src/utils.py:Base", "inherits"), ("class:src/main.py:App", "function:src/main.py:go", "contains"), ("schema:schema.sql", "table:schema.sql:users", "contains")):
        assert want in have, want
    ids = {r["id"] for r in made.nodes.select("id").collect()}
    assert all(a in ids and b in ids for a, b, _ in have)
    row = made.project.first()
    assert row["frameworks"] == ["react"] and {"python", "typescript"} <= set(row["languages"])
    assert made.tour.count() >= 2 and {r["name"] for r in made.layers.collect()} == {"Core"} | {r["name"] for r in made.layers.collect()}


def test_plugins(spark):
    own = registry.default_registry()
    own.register("mine", ("python",), lambda text: {"functions": [{"name": "mine", "line_start": 1, "line_end": 1, "params": []}]})
    files = spark.createDataFrame([("a.py", "def x(): pass\n")], "path string, content string")
    assert registry.analyze(files, own).select(F.inline("functions")).first()["name"] == "mine"
    own.unregister("mine")
    assert registry.analyze(files, own).select(F.inline("functions")).first()["name"] == "x"


@pytest.mark.parametrize("kind", ["parquet", "json"])
def test_store_and_sync(spark, tmp_path, kind):
    store = Store(spark, f"file://{tmp_path}/g-{kind}", kind)
    assert store.load_graph() is None and store.get("k") is None and store.load_config().first()[0] is False
    files = spark.createDataFrame(FILES[:3] + [(f"src/m{i}.py", f"def f{i}(): pass\n") for i in range(6)], "path string, content string")
    assert sync.sync(files, store).action == "FULL_UPDATE"
    before = store.load_graph()
    n = before["nodes"].count()
    assert sync.sync(files, store).action == "SKIP" and not sync.status(files, store)[0]
    changed = files.where("path <> 'src/m1.py'").union(spark.createDataFrame([("src/m1.py", "def f1(): pass\ndef g1(): return f1()\n")], files.schema))
    done = sync.sync(changed, store)
    assert done.action == "PARTIAL_UPDATE", done.reason
    after = store.load_graph(validate=True)
    assert after["nodes"].count() == n + 1
    assert after["edges"].where("type = 'calls' AND source = 'function:src/m1.py:g1'").count() == 1
    have = {(r["source"], r["target"], r["type"]) for r in after["edges"].collect()}
    assert ("function:src/main.py:run", "function:src/utils.py:helper", "calls") in have and ("file:src/main.py", "file:src/utils.py", "imports") in have
    edited = changed.where("path <> 'src/main.py'").union(spark.createDataFrame([("src/main.py", FILES[1][1] + "\ndef more(x):\n    return helper(x)\n")], files.schema))
    assert sync.sync(edited, store).action == "PARTIAL_UPDATE"
    again = store.load_graph()
    have = {(r["source"], r["target"], r["type"]) for r in again["edges"].collect()}
    assert ("function:src/main.py:run", "function:src/utils.py:helper", "calls") in have and ("file:src/main.py", "file:src/utils.py", "imports") in have
    assert again["tour"].count() >= 1 and again["layers"].count() >= 1 and again["nodes"].where("id = 'function:src/main.py:more'").count() == 1
    store.put("k", "1")
    store.put("k", "2")
    assert store.get("k") == "2" and store.version() == 1
    assert store.migrate(3, [(2, {"fingerprints": lambda df: df.withColumn("x", F.lit(1))}), (9, {})]) == 2
    assert "x" in store.read("fingerprints").columns
    store.save_config(True)
    store.save_meta("abc", analyzed_files=42)
    assert store.load_config().first()[0] is True and store.load_all()["meta"].first()["analyzed_files"] == 42
    store.clear()
    assert store.load_graph() is None


def test_read_files_and_cli(spark, tmp_path, capsys):
    for path, text in FILES:
        target = tmp_path / "shop" / path
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_text(text)
    (tmp_path / "shop/bin.dat").write_bytes(b"a\x00b")
    (tmp_path / "shop/latin.txt").write_bytes("é".encode("latin-1"))
    (tmp_path / "shop/.env").write_text("A=1\n")
    (tmp_path / "shop/src/_own part.py").write_text("x = 1\n")
    (tmp_path / "shop/node_modules").mkdir()
    (tmp_path / "shop/node_modules/x.js").write_text("x")
    got = {r["path"]: r["content"] for r in file_source.read_files(spark, str(tmp_path / "shop")).collect()}
    assert set(got) == {p for p, _ in FILES} | {"bin.dat", "latin.txt", ".env", "src/_own part.py"} and got["bin.dat"] is None and got["latin.txt"] == "é"
    assert file_source.git_commit(str(tmp_path)) == "unknown"
    cli.main(["build", "-p", str(tmp_path)])
    cli.main(["query", "HELP", "-p", str(tmp_path / "shop")])
    cli.main(["stats", "-p", str(tmp_path / "shop")])
    said = capsys.readouterr().out
    assert "nodes" in said and "function:src/utils.py:helper" in said


def test_updates(spark):
    def decide(counts, total, known=()):
        rows = [(f"d/{c}{i}", c) for c, n in counts.items() for i in range(n)]
        changes = spark.createDataFrame(rows, "file_path string, change_class string") if rows else spark.createDataFrame([], "file_path string, change_class string")
        return incremental.classify_update(changes, total, spark.createDataFrame([(k,) for k in known] or [("d/x",)], "file_path string")).first()

    assert decide({}, 10)["reason"] == "No changes detected"
    assert decide({"cosmetic": 2}, 10)["reason"].startswith("2 file(s) have cosmetic-only")
    assert decide({"structural": 5}, 10)["action"] == "PARTIAL_UPDATE" and decide({"structural": 6}, 10)["action"] == "FULL_UPDATE"
    assert decide({"structural": 11}, 100)["action"] == "ARCHITECTURE_UPDATE" and decide({"structural": 31}, 1000)["action"] == "FULL_UPDATE"
    assert decide({"new": 1}, 100, ["e/x"])["reason"] == "Directory structure changed (1 new, 0 deleted files)"
    assert decide({"structural": 1, "new": 2}, 100)["reason"] == "3 file(s) have structural changes: 2 new, 1 modified"


def test_imports(spark):
    files = spark.createDataFrame([(p,) for p in ("a/b.py", "a/c/__init__.py", "a/d.ts", "e.h", "x/index.ts")], "path string")
    asked = [("a/m.py", "a.b", "python", "a/b.py"), ("a/m.py", "a.c", "python", "a/c/__init__.py"), ("a/m.ts", "./d", "typescript", "a/d.ts"), ("a/m.ts", "../../d", "typescript", None), ("a/q/m.c", "../../e", "c", "e.h"), ("m.ts", "x", "typescript", "x/index.ts"), ("m.go", "a/d", None, "a/d.ts"), ("m.py", ".b", "python", None)]
    df = spark.createDataFrame(asked, "file string, source string, language string, want string")
    got = {(r["file"], r["source"]): r["target"] for r in resolve.imports_to_files(df, files).collect()}
    assert got == {(f, s): w for f, s, _, w in asked if w}


def test_fingerprints(spark):
    old = project_prints(spark, "def a(x):\n    return 1\n\nclass K:\n    def m(self):\n        pass\n")
    new = project_prints(spark, "import os\ndef a(x, y) -> int:\n    b = 1\n    c = 2\n    return 1\n\nclass K:\n    def n(self):\n        pass\n")
    row = incremental.compare(old, new).first()
    assert row["change_class"] == "structural"
    assert row["details"] == ["params changed: a", "return type changed: a", "significant size change: a (2 -> 4 lines)", "methods changed: K", "imports changed"]


def project_prints(spark, text):
    files = spark.createDataFrame([("k.py", text)], "path string, content string")
    return storage.materialize(incremental.fingerprints(files, registry.analyze(files)), f"prints-{uuid.uuid4().hex}")


def test_small_side_is_checked(spark):
    df = spark.range(100)
    assert "broadcast" in storage.small(df, 8)._jdf.queryExecution().toString().lower()
    assert "broadcast" not in storage.small(df, 8, limit=80)._jdf.queryExecution().logical().toString().lower()


def test_builder_keeps_the_first_of_equal_ids(spark):
    files = spark.createDataFrame([("a.py", "def f(): pass\n\nclass C:\n    def f(self): pass\n    def g(self): pass\n")], "path string, content string")
    nodes, edges, _ = build.build(files, storage.materialize(registry.analyze(files), "analyses"))
    assert nodes.where("id = 'function:a.py:f'").count() == 1
    assert {(r["source"], r["target"]) for r in edges.where("type = 'contains'").collect()} == {("file:a.py", "function:a.py:f"), ("file:a.py", "class:a.py:C"), ("class:a.py:C", "function:a.py:g")}


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert SF
