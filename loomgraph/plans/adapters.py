"""The engine's relations over the shared tables: event and commerce graphs, document lines, page links; with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import storage
from ..storage import dealt, spread


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, d: str) -> DataFrame:
    """Events with their node: event type and the key in props."""
    return load(spark, d, "events").withColumn("node", F.concat_ws(":", "event_type", F.get_json_object("props", "$.k")))


def event_nodes(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d).select(F.col("node").alias("id"), F.col("node").alias("name"), F.col("event_type").alias("kind")).distinct()


def event_symbols(spark: SparkSession, d: str) -> DataFrame:
    """Event nodes with the fields that a question is matched against; the summary and intent follow the event type."""
    kind = F.col("kind")
    summary = F.when(kind == "purchase", "buys an order").when(kind == "error", "raises an exception").when(kind == "signup", "registers an account").when(kind == "view", "shows a page").otherwise("presses a button")
    return event_nodes(spark, d).select("id", "name", F.lit("function").alias("kind"), summary.alias("summary"), kind.alias("file"), F.when(kind == "error", "error_handling").when(kind == "purchase", "persistence").when(kind == "view", "retrieval").otherwise("unknown").alias("intent"))


def event_edges(spark: SparkSession, d: str) -> DataFrame:
    """Consecutive events of a user, counted; no self-loops."""
    by = W.partitionBy("user_id").orderBy("ts", "event_id")
    step = events(spark, d).select(F.col("node").alias("src"), F.lead("node").over(by).alias("dst"))
    return step.where("dst is not null and src <> dst").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("w"))


def commerce_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers (classes) and customers (functions) as symbols; nation is their file, region their module.

    Semantic kind and decorators follow the market segment, complexity and criticality the balance.
    """
    place = load(spark, d, "nation").join(F.broadcast(load(spark, d, "region")), F.col("n_regionkey") == F.col("r_regionkey"))  # 25 and 5 rows
    both = load(spark, d, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("k"), F.lit("type").alias("kind"), F.lit("class").alias("type"), F.col("s_acctbal").alias("bal"), F.lit("").alias("segment"))
    both = both.union(load(spark, d, "customer").select(F.concat(F.lit("c"), "c_custkey"), "c_name", "c_nationkey", F.lit("function"), F.lit("function"), "c_acctbal", "c_mktsegment"))
    bal, seg = F.col("bal"), F.col("segment")
    return both.join(F.broadcast(place), F.col("k") == F.col("n_nationkey")).select(
        "id", "name", "kind", "type", "bal", F.col("r_name").alias("module"), F.concat_ws("/", "r_name", "n_name").alias("file"),
        F.when(seg == "", "Supplies parts").otherwise(F.concat(F.lower("segment"), F.lit(" account"))).alias("summary"),
        F.when(seg == "MACHINERY", "EXPOSES_API").when(seg == "BUILDING", "CONSUMES_EVENT").otherwise("CALLS").alias("semantic_kind"), F.when(seg == "FURNITURE", "cached").otherwise("").alias("decorators"),
        F.when(bal < 0, "low").when(bal < 3000, "medium").when(bal < 7000, "high").otherwise("very_high").alias("complexity"),
        F.when(bal < 2000, "low").when(bal < 6000, "medium").when(bal < 9000, "high").otherwise("critical").alias("criticality"),
    )


def _pairs(orders: DataFrame, lines: DataFrame, **flags: str) -> DataFrame:
    """Distinct customer -> supplier, dealt by customer: joins on it shuffle no pair again, and no task takes more as bytes compress.

    ``flags`` are conditions on an order; a pair has one if any of its orders has. Tasks grow in number with the lines, not in
    what each holds; a line's two keys are few bytes, so that a task takes four times as many of those.
    """
    n = lines.count()
    orders = orders.select("o_orderkey", F.concat(F.lit("c"), "o_custkey").alias("src"), *[F.expr(x).alias(f) for f, x in flags.items()])
    lines = spread(lines, n, "l_orderkey", share=4 * storage.SHARE).select("l_orderkey", F.concat(F.lit("s"), "l_suppkey").alias("dst"))
    rows = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select("src", "dst", *flags)
    rows = dealt(rows, "src", rows=n)
    return rows.groupBy("src", "dst").agg(*[F.max(f).alias(f) for f in flags]) if flags else rows.distinct()


def commerce_edges(spark: SparkSession, d: str, **flags: str) -> DataFrame:
    """Distinct customer -> supplier over all orders and lines."""
    return _pairs(load(spark, d, "orders"), load(spark, d, "lineitem"), **flags)


URGENT = "o_orderpriority = '1-URGENT'"


def commerce_imports(spark: SparkSession, d: str) -> DataFrame:
    """Distinct file -> file dependencies: those of urgent orders' customers on their suppliers."""
    n = commerce_nodes(spark, d)
    pairs = _pairs(load(spark, d, "orders").where(URGENT), load(spark, d, "lineitem"))
    ends = pairs.join(n.select(F.col("id").alias("src"), F.col("file").alias("sf")), "src").join(n.select(F.col("id").alias("dst"), F.col("file").alias("tf")), "dst")
    return ends.where("sf <> tf").select("sf", "tf").distinct()


def doc_lines(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "text"))


def page_links(spark: SparkSession, d: str) -> DataFrame:
    found = F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))
    return load(spark, d, "pages").select("page_id", F.posexplode(found).alias("pos", "href"))


CTE = {
    "ev": "ev AS (SELECT *, event_type || ':' || json_extract_string(props, '$.k') AS node FROM events)",
    "enodes": "enodes AS (SELECT DISTINCT node AS id, node AS name, event_type AS kind FROM ev)",
    "esym": "esym AS (SELECT id, name, kind AS file, CASE kind WHEN 'purchase' THEN 'buys an order' WHEN 'error' THEN 'raises an exception' WHEN 'signup' THEN 'registers an account' WHEN 'view' THEN 'shows a page' ELSE 'presses a button' END AS summary, CASE kind WHEN 'error' THEN 'error_handling' WHEN 'purchase' THEN 'persistence' WHEN 'view' THEN 'retrieval' ELSE 'unknown' END AS intent FROM enodes)",
    "eedges": "eedges AS (SELECT src, dst, count(*) AS w FROM (SELECT node AS src, lead(node) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS dst FROM ev) WHERE dst IS NOT NULL AND src <> dst GROUP BY src, dst)",
    "cnodes": "cnodes AS (SELECT id, name, kind, type, bal, r_name AS module, r_name || '/' || n_name AS file, CASE WHEN seg = '' THEN 'Supplies parts' ELSE lower(seg) || ' account' END AS summary, CASE seg WHEN 'MACHINERY' THEN 'EXPOSES_API' WHEN 'BUILDING' THEN 'CONSUMES_EVENT' ELSE 'CALLS' END AS semantic_kind, CASE seg WHEN 'FURNITURE' THEN 'cached' ELSE '' END AS decorators, CASE WHEN bal < 0 THEN 'low' WHEN bal < 3000 THEN 'medium' WHEN bal < 7000 THEN 'high' ELSE 'very_high' END AS complexity, CASE WHEN bal < 2000 THEN 'low' WHEN bal < 6000 THEN 'medium' WHEN bal < 9000 THEN 'high' ELSE 'critical' END AS criticality FROM (SELECT 's' || s_suppkey AS id, s_name AS name, s_nationkey AS k, 'type' AS kind, 'class' AS type, s_acctbal AS bal, '' AS seg FROM supplier UNION ALL SELECT 'c' || c_custkey, c_name, c_nationkey, 'function', 'function', c_acctbal, c_mktsegment FROM customer) JOIN nation ON k = n_nationkey JOIN region ON n_regionkey = r_regionkey)",
    "cedges": "cedges AS (SELECT DISTINCT 'c' || o_custkey AS src, 's' || l_suppkey AS dst FROM lineitem JOIN orders ON l_orderkey = o_orderkey)",
    "lines": "lines AS (SELECT doc_id, unnest(range(len(parts)))::INT AS line, unnest(parts) AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents))",
    "links": "links AS (SELECT page_id, unnest(range(len(h)))::INT AS pos, unnest(h) AS href FROM (SELECT page_id, regexp_extract_all(html, 'href=\"([^\"]*)\"', 1) AS h FROM pages))",
}


def with_(*names: str, recursive: bool = False) -> str:
    return ("WITH RECURSIVE " if recursive else "WITH ") + ", ".join(CTE[n] for n in names)
