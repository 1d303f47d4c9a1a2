"""The star-schema tables seen as a graph of a software project, and as files, references and change records.

Each function reads the tables it needs below ``root`` and returns a DataFrame; none collects anything.
``ord`` is the place of a row in its list, from keys alone, so that first and last are defined at any size.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Room for the keys of one table in ``ord``.
BAND = 10**15
FOLDERS = ("routes", "services", "models", "components", "utils", "tests", "misc", "workers")
SUFFIXES = ("py", "ts", "java")
DOC_SUFFIXES = ("md", "yaml", "sql", "sh", "txt")
_NO_TAGS = "cast(array() as array<string>)"
#: Keys, and rows of which texts are put together, that go to one task at most, about.
DEALT_KEYS = 20_000
DEALT_ROWS = 100_000


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}.parquet")


def dealt(rows: DataFrame, most: int, *by: str) -> DataFrame:
    """``rows`` in parts of about ``most``: one partition of a scan holds millions of keys, and the text of each is parsed."""
    parts = -(-rows.count() // most)
    return rows if parts < 2 else rows.repartition(parts, *by)


def _key(kind: str, col: str) -> Column:
    return F.concat(F.lit(f"{kind}:"), F.col(col).cast("string"))


def _picked(values: tuple[str, ...], key: str) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.pmod(F.col(key), F.lit(len(values))) + 1).cast("int"))


def customer_path(key: str) -> Column:
    return F.concat(F.lit("src/"), _picked(FOLDERS, key), F.lit("/customer"), F.col(key).cast("string"), F.lit("."), _picked(SUFFIXES, key))


def nodes(spark: SparkSession, root: str) -> DataFrame:
    """region: domain, nation: module, customer: service, supplier: resource, part: class, order: function."""

    def rows(name: str, kind: str, band: int, key: str, label: Column, summary: Column, path: Column, tags: Column, complexity: Column, notes: Column) -> DataFrame:
        return table(spark, root, name).select(
            _key("order" if name == "orders" else name, key).alias("id"),
            F.lit(kind).alias("type"),
            label.alias("name"),
            path.cast("string").alias("file_path"),
            summary.alias("summary"),
            tags.alias("tags"),
            complexity.alias("complexity"),
            notes.cast("string").alias("language_notes"),
            (F.lit(band * BAND) + F.col(key)).alias("ord"),
        )

    none, simple, no_tags = F.lit(None), F.lit("simple"), F.expr(_NO_TAGS)
    balance = F.when(F.col("c_acctbal") < 0, "simple").when(F.col("c_acctbal") < 5000, "moderate").otherwise("complex")
    price = F.when(F.col("o_totalprice") < 100000, "simple").when(F.col("o_totalprice") < 200000, "moderate").otherwise("complex")
    parts = [
        rows("region", "domain", 0, "r_regionkey", F.col("r_name"), F.concat(F.lit("Region "), F.col("r_name")), none, no_tags, simple, none),
        rows("nation", "module", 1, "n_nationkey", F.col("n_name"), F.concat(F.lit("Nation "), F.col("n_name")), none, no_tags, simple, none),
        rows("customer", "service", 2, "c_custkey", F.col("c_name"), F.concat(F.lit("Service of segment "), F.col("c_mktsegment")), customer_path("c_custkey"), F.array(F.lower("c_mktsegment")), balance, none),
        rows("supplier", "resource", 3, "s_suppkey", F.col("s_name"), F.concat(F.lit("Supplier with balance "), F.col("s_acctbal").cast("int").cast("string")), none, no_tags, simple, none),
        rows("part", "class", 4, "p_partkey", F.col("p_name"), F.concat_ws(" ", F.col("p_name"), F.lit("by"), F.col("p_brand")), none, F.split(F.lower("p_type"), " "), simple, F.lower("p_type")),
        rows("orders", "function", 5, "o_orderkey", F.concat(F.lit("order_"), F.col("o_orderkey").cast("string")), F.concat(F.lit("Order of priority "), F.col("o_orderpriority")), customer_path("o_custkey"), F.array(F.lower("o_orderstatus")), price, none),
    ]
    return reduce(DataFrame.unionByName, parts)


def call_chain(spark: SparkSession, root: str) -> DataFrame:
    """``source, target, ord``: each order calls the next one of its customer."""
    following = F.lead("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    chain = table(spark, root, "orders").select("o_orderkey", following.alias("then")).where("then IS NOT NULL")
    return chain.select(_key("order", "o_orderkey").alias("source"), _key("order", "then").alias("target"), (F.lit(3 * BAND) + F.col("o_orderkey")).alias("ord"))


def edges(spark: SparkSession, root: str) -> DataFrame:
    """Regions contain nations, these customers; orders call their customer and the next order, import parts, depend on suppliers."""

    def typed(df: DataFrame, kind: str, weight: Column) -> DataFrame:
        return df.select("source", "target", F.lit(kind).alias("type"), F.lit("forward").alias("direction"), F.lit(None).cast("string").alias("description"), weight.cast("double").alias("weight"), "ord")

    nation, customer, orders, lines = (table(spark, root, t) for t in ("nation", "customer", "orders", "lineitem"))

    def ends(kind: str, key: str, band: int, share: Column) -> DataFrame:
        """One row for each order and what it names; the window's partitioning serves the grouping, too."""
        turn = F.dense_rank().over(Window.partitionBy("l_orderkey").orderBy(key))
        ranked = lines.select("l_orderkey", key, "l_discount", turn.alias("turn"))
        grouped = ranked.groupBy("l_orderkey", key, "turn").agg(share.alias("share"))
        return grouped.select(_key("order", "l_orderkey").alias("source"), _key(kind, key).alias("target"), (F.lit(band * BAND) + F.col("l_orderkey") * 1000 + F.col("turn")).alias("ord"), "share")

    part = ends("part", "l_partkey", 4, F.lit(0.0))
    supplier = ends("supplier", "l_suppkey", 5, F.max("l_discount"))
    parts = [
        typed(nation.select(_key("region", "n_regionkey").alias("source"), _key("nation", "n_nationkey").alias("target"), F.col("n_nationkey").cast("bigint").alias("ord")), "contains", F.lit(1.0)),
        typed(customer.select(_key("nation", "c_nationkey").alias("source"), _key("customer", "c_custkey").alias("target"), (F.lit(BAND) + F.col("c_custkey")).alias("ord")), "contains", F.lit(1.0)),
        typed(orders.select(_key("order", "o_orderkey").alias("source"), _key("customer", "o_custkey").alias("target"), (F.lit(2 * BAND) + F.col("o_orderkey")).alias("ord")), "calls", F.lit(0.8)),
        typed(call_chain(spark, root), "calls", F.lit(0.8)),
        typed(part, "imports", F.lit(0.7)),
        typed(supplier, "depends_on", F.col("share") * 10),
    ]
    return reduce(DataFrame.unionByName, parts)


def dirty_nodes(spark: SparkSession, root: str) -> DataFrame:
    """The nodes as an unreliable producer would write them: wrong case, aliases, gaps."""
    n, o = nodes(spark, root), F.col("ord")
    alias = F.when(F.col("type") == "function", "Func").when(F.col("type") == "class", "struct").when(F.col("type") == "module", "PKG").when(F.col("type") == "service", "pod").otherwise(F.col("type"))
    return n.select(
        "ord",
        F.when(o % 29 != 0, F.col("id")).alias("id"),
        F.when(o % 7 == 0, F.upper("type")).when(o % 7 == 1, alias).when(o % 7 == 2, F.lit(None)).when(o % 7 == 3, "gadget").otherwise(F.col("type")).alias("type"),
        F.when(o % 13 != 0, F.col("name")).alias("name"),
        "file_path",
        F.when(o % 11 == 0, "").otherwise(F.col("summary")).alias("summary"),
        F.when(o % 3 != 0, F.col("tags")).alias("tags"),
        F.when(o % 5 == 0, "HIGH").when(o % 5 == 1, F.lit(None)).when(o % 5 == 2, "easy").when(o % 23 == 3, "weird").otherwise(F.col("complexity")).alias("complexity"),
        "language_notes",
    )


def dirty_edges(spark: SparkSession, root: str) -> DataFrame:
    """The edges likewise; a weight is a number (``weight``), a text (``weight_text``), or missing."""
    e, o = edges(spark, root), F.col("ord")
    return e.select(
        "ord",
        "source",
        F.when(o % 17 == 0, F.concat(F.lit("ghost:"), o.cast("string"))).otherwise(F.col("target")).alias("target"),
        F.when(o % 7 == 0, F.upper("type")).when(o % 7 == 1, "Invokes").when(o % 7 == 2, F.lit(None)).when(o % 19 == 3, "nope").otherwise(F.col("type")).alias("type"),
        F.when(o % 5 == 0, "TO").when(o % 5 == 1, F.lit(None)).when(o % 5 == 2, "both").when(o % 31 == 3, "sideways").otherwise(F.col("direction")).alias("direction"),
        "description",
        F.when(o % 9 == 5, 1.7).when(o % 9 == 6, -0.2).when(o % 9 > 6, F.col("weight")).alias("weight"),
        F.when(o % 9 == 1, "abc").when(o % 9 == 2, "1.7").when(o % 9 == 3, "0.25").alias("weight_text"),
    )


def messy_ids(spark: SparkSession, root: str) -> DataFrame:
    """Node ids with junk prefixes, doubled prefixes, or none; ``type, name, file_path`` beside them."""
    n, o = nodes(spark, root), F.col("ord")
    real = F.concat(F.when(F.col("type") == "function", "func").otherwise(F.col("type")), F.lit(":"), F.coalesce("file_path", "name"))
    raw = (
        F.when(o % 6 == 0, F.concat(F.lit("my-project:"), real))
        .when(o % 6 == 1, F.concat(F.lit("file:"), real))
        .when(o % 6 == 2, F.coalesce("file_path", "name"))
        .when(o % 6 == 3, F.concat(F.lit("  "), real, F.lit(" ")))
        .when(o % 6 == 4, F.concat(F.lit(":"), F.col("name")))
        .otherwise(real)
    )
    return n.select("ord", raw.alias("id"), "type", "name", "file_path")


def document_files(spark: SparkSession, root: str) -> DataFrame:
    """``path, content`` of one file for each document."""
    path = F.concat(F.lit("src/"), _picked(FOLDERS, "doc_id"), F.lit("/doc"), F.col("doc_id").cast("string"), F.lit("."), _picked(DOC_SUFFIXES, "doc_id"))
    return table(spark, root, "documents").select(path.alias("path"), F.coalesce("text", F.lit("")).alias("content"), "doc_id")


def python_files(spark: SparkSession, root: str) -> DataFrame:
    """``path, content`` of one Python file for each customer: a function for each order, which calls the next one."""
    chain = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    orders = dealt(table(spark, root, "orders").select("o_custkey", "o_orderkey"), DEALT_ROWS, "o_custkey").select("o_custkey", "o_orderkey", F.lead("o_orderkey").over(chain).alias("then"))
    body = F.concat(
        F.lit("def order_"), F.col("o_orderkey").cast("string"), F.lit("(total, *rest: int, status='O') -> str:\n    return "),
        F.coalesce(F.concat(F.lit("order_"), F.col("then").cast("string"), F.lit("(total)")), F.lit("settle(total)")), F.lit("\n"),
    )
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", body.alias("body")))), lambda r: r["body"]), "\n")
    head = F.concat(F.lit("import os\nfrom src.shared.book import settle as close_book\n\nLIMIT: int = "), F.col("o_custkey").cast("string"), F.lit("\n\n"))
    grouped = orders.groupBy("o_custkey").agg(text.alias("text"))
    path = F.concat(F.lit("src/"), _picked(FOLDERS, "o_custkey"), F.lit("/customer"), F.col("o_custkey").cast("string"), F.lit(".py"))
    return grouped.select(path.alias("path"), F.concat(head, F.col("text")).alias("content"))


def snapshot(spark: SparkSession, root: str, new: bool) -> DataFrame:
    """Fingerprints of a file for each order, whose functions are its lines: before (``new`` False) and after a change.

    Afterwards orders with key % 7 = 1 are gone, those with key % 7 = 2 came in (they were missing before), and
    lines with l_partkey % 11 = 3 got another parameter, % 11 = 4 another name, % 11 = 5 three times the length.
    """
    lines = table(spark, root, "lineitem").where(F.col("l_orderkey") % 7 != (1 if new else 2))
    p = F.col("l_partkey") % 11
    name = F.concat(F.lit("fn_"), F.col("l_partkey").cast("string"), F.when((p == 4) & F.lit(new), "_v2").otherwise(""))
    params = F.array(F.col("l_returnflag"), F.when((p == 3) & F.lit(new), "extra").otherwise(F.col("l_linestatus")))
    length = (F.col("l_quantity") * F.when((p == 5) & F.lit(new), 3).otherwise(1)).cast("int")
    fn = F.struct(name.alias("name"), params.alias("params"), F.lit(None).cast("string").alias("return_type"), (F.col("l_linenumber") % 2 == 0).alias("exported"), length.alias("line_count"))
    ordered = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", fn.alias("fn"))))
    by = lines.groupBy("l_orderkey").agg(F.transform(ordered, lambda r: r["fn"]).alias("functions"))
    text = F.to_json(F.col("functions"))
    nothing = "array<struct<name: string, methods: array<string>, properties: array<string>, exported: boolean, line_count: int>>"
    return by.select(
        F.concat(F.lit("src/d"), (F.col("l_orderkey") % 5).cast("string"), F.lit("/o"), F.col("l_orderkey").cast("string"), F.lit(".py")).alias("file_path"),
        F.sha2(text, 256).alias("content_hash"),
        "functions",
        F.expr(f"cast(array() as {nothing})").alias("classes"),
        F.expr("cast(array() as array<struct<source: string, specifiers: array<string>>>)").alias("imports"),
        F.transform(F.filter("functions", lambda f: f["exported"]), lambda f: f["name"]).alias("exports"),
        F.aggregate("functions", F.lit(0), lambda a, f: a + f["line_count"]).alias("total_lines"),
        (F.col("l_orderkey") % 50 != 0).alias("has_structural_analysis"),
    )


def references(spark: SparkSession, root: str) -> DataFrame:
    """``source_file, symbol, ref_type``: parts that orders name, some with a qualifier, some in another case."""
    k = F.col("l_partkey")
    symbol = F.when(k % 5 == 0, F.concat(F.lit("shop.part_"), k.cast("string"))).when(k % 5 == 1, F.concat(F.lit("PART_"), k.cast("string"))).when(k % 5 == 2, F.lit("print")).otherwise(F.concat(F.lit("part_"), k.cast("string")))
    return table(spark, root, "lineitem").select(F.concat(F.lit("src/o"), (F.col("l_orderkey") % 1000).cast("string"), F.lit(".py")).alias("source_file"), symbol.alias("symbol"), F.lit("call").alias("ref_type")).distinct()


def symbols(spark: SparkSession, root: str) -> DataFrame:
    """``name, file, kind, ord``: each part is a symbol of the file of its brand."""
    return table(spark, root, "part").select(F.concat(F.lit("part_"), F.col("p_partkey").cast("string")).alias("name"), F.concat(F.lit("lib/"), F.lower(F.replace("p_brand", F.lit("#"), F.lit(""))), F.lit(".py")).alias("file"), F.lit("function").alias("kind"), F.col("p_partkey").alias("ord"))


def replies(spark: SparkSession, root: str) -> DataFrame:
    """``reply_id, reply``: model replies with a JSON analysis, some fenced, some bare, some broken."""
    e = table(spark, root, "events")
    obj = F.concat(F.lit('{"fileSummary": "'), F.col("event_type"), F.lit('", "tags": ["'), F.col("event_type"), F.lit('", "u'), F.col("user_id").cast("string"), F.lit('"], "complexity": "'), F.when(F.col("event_id") % 3 == 0, "complex").otherwise("odd"), F.lit('", "functionSummaries": '), F.col("props"), F.lit("}"))
    text = F.when(F.col("event_id") % 4 == 0, F.concat(F.lit("Here:\n```json\n"), obj, F.lit("\n```\nDone."))).when(F.col("event_id") % 4 == 1, F.concat(F.lit("Sure. "), obj)).when(F.col("event_id") % 4 == 2, obj).otherwise(F.concat(F.lit("{ broken "), F.col("event_type")))
    return e.select(F.col("event_id").alias("reply_id"), text.alias("reply"))
