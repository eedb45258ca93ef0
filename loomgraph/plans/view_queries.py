"""Queries of views, labels and derived texts over the event and commerce graphs, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vocabulary as V
from ..operators import graph as G
from ..operators import learning as L
from ..operators import retrieval as R
from . import adapters as A
from .adapters import with_
from .graph_queries import _CDEG, _ENDS, ASKED, CO, _bfs_sql, _cdeg, _ends
from .registry import registry

QUERIES, SQL, query = registry(__name__)


@query(CO + ", e AS (SELECT a.module AS s, b.module AS t" + _ENDS + "), n AS (SELECT module, count(*) AS n_nodes, count(DISTINCT file) AS n_files, count(*) FILTER (kind = 'function') AS n_functions FROM cnodes GROUP BY module) SELECT n.*, (SELECT count(*) FROM e WHERE s = module AND t = module) AS n_inside, (SELECT count(*) FROM e WHERE s = module AND t <> module) AS n_out, (SELECT count(*) FROM e WHERE t = module AND s <> module) AS n_in FROM n")
def module_details(spark: SparkSession, d: str) -> DataFrame:
    """Each module's members by kind, and its edges inside, outward and inward."""
    n = A.commerce_nodes(spark, d).groupBy("module").agg(F.count(F.lit(1)).alias("n_nodes"), F.countDistinct("file").alias("n_files"), F.count_if(F.col("kind") == "function").alias("n_functions"))
    pair = _ends(spark, d).groupBy("sm", "tm").agg(F.count(F.lit(1)).alias("c"))
    same, zero = F.col("sm") == F.col("tm"), F.lit(0)
    one = pair.select(F.col("sm").alias("module"), F.when(same, F.col("c")).otherwise(zero).alias("a"), F.when(same, zero).otherwise(F.col("c")).alias("b"), zero.alias("i"))
    one = one.union(pair.where(~same).select("tm", zero, zero, "c"))
    e = one.groupBy("module").agg(F.sum("a").alias("n_inside"), F.sum("b").alias("n_out"), F.sum("i").alias("n_in"))
    return n.join(e, "module", "left").na.fill(0, ["n_inside", "n_out", "n_in"])


@query(CO + ", c AS (SELECT module, file, count(*) AS n FROM cnodes GROUP BY ALL) SELECT module, first(file ORDER BY n DESC, file) AS hint FROM c GROUP BY module")
def module_name_hint(spark: SparkSession, d: str) -> DataFrame:
    """The directory that most members of a module have; ties go to the first name."""
    c = A.commerce_nodes(spark, d).groupBy("module", "file").agg(F.count(F.lit(1)).alias("n"))
    return c.groupBy("module").agg(F.min_by("file", F.struct(-F.col("n"), "file")).alias("hint"))


@query(CO + " SELECT module, id, pos, pos = 1 AS representative FROM (SELECT module, id, row_number() OVER (PARTITION BY module ORDER BY bal DESC, id)::INT AS pos FROM cnodes WHERE kind = 'function') WHERE pos <= 5")
def module_top_functions(spark: SparkSession, d: str) -> DataFrame:
    """Five functions of each module by weight; the first represents it."""
    by = W.partitionBy("module").orderBy(F.desc("bal"), "id")
    top = A.commerce_nodes(spark, d).where("kind = 'function'").select("module", "id", F.row_number().over(by).alias("pos")).where("pos <= 5")
    return top.withColumn("representative", F.col("pos") == 1)


@query("WITH l AS (SELECT p_partkey, CASE WHEN count(*) OVER (PARTITION BY p_type) > 1 THEN p_type || ' · ' || p_brand ELSE p_type END AS base FROM part) SELECT p_partkey, base || CASE WHEN row_number() OVER (PARTITION BY base ORDER BY p_partkey) > 1 THEN ' #' || row_number() OVER (PARTITION BY base ORDER BY p_partkey) ELSE '' END AS label FROM l")
def label_disambiguate(spark: SparkSession, d: str) -> DataFrame:
    """Repeated names get a representative's name, and what is still repeated a number."""
    part = A.load(spark, d, "part").select("p_partkey", "p_type", "p_brand")
    n = part.groupBy("p_type").agg(F.count(F.lit(1)).alias("n"))  # counts, so a common name isn't one task's window
    base = part.join(n, "p_type").select("p_partkey", F.when(F.col("n") > 1, F.concat_ws(" · ", "p_type", "p_brand")).otherwise(F.col("p_type")).alias("base"))
    r = F.row_number().over(W.partitionBy("base").orderBy("p_partkey"))
    return base.withColumn("r", r).select("p_partkey", F.when(F.col("r") > 1, F.concat(F.col("base"), F.lit(" #"), F.col("r"))).otherwise(F.col("base")).alias("label"))


_WIDTH = "CASE complexity " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in V.BORDERS.items()) + " ELSE 1 END"


@query(CO + _CDEG + f", r AS (SELECT *, (fan_in + fan_out) / max(fan_in + fan_out) OVER () AS fan, greatest(bal, 0) / max(bal) OVER () AS pr FROM cd) SELECT id, {_WIDTH}::DOUBLE AS border, round(sqrt(fan) * 34, 0)::DOUBLE AS size, CASE WHEN pr >= 0.18 THEN round(5 + pr * 16, 0) END::DOUBLE AS blur, CASE WHEN pr >= 0.18 THEN round(0.2 + pr * 0.4, 2) END::DOUBLE AS opacity FROM r")
def visual_encodings(spark: SparkSession, d: str) -> DataFrame:
    """Border by complexity, size by degree and glow by centrality (here the balance), against the whole graph's largest."""
    c = _cdeg(spark, d)
    top = c.agg(F.max(F.col("fan_in") + F.col("fan_out")).alias("f"), F.max("bal").alias("b"))
    c = c.join(F.broadcast(top))  # one row
    blur, opacity = T.glow(F.greatest(F.col("bal"), F.lit(0.0)) / F.col("b"))
    size = F.round(F.sqrt((F.col("fan_in") + F.col("fan_out")) / F.col("f")) * 34, 0)
    return c.select("id", T.border(F.col("complexity")).alias("border"), size.alias("size"), blur.alias("blur"), opacity.alias("opacity"))


@query(_bfs_sql(2) + f" SELECT '(stub) According to the graph, the execution path for ''{ASKED}'' is: ' || string_agg(id, ' → ' ORDER BY visit) AS explanation FROM (SELECT * FROM s2 ORDER BY visit LIMIT 5)")
def explanation_text(spark: SparkSession, d: str) -> DataFrame:
    """The explanation without a model: the first five nodes of a question's subgraph."""
    found = R.retrieve(A.event_symbols(spark, d), A.event_edges(spark, d), ASKED, 2)
    return R.explanation(found, ASKED)


@query(_bfs_sql(2) + ", f AS (SELECT *, row_number() OVER (ORDER BY visit) AS pos FROM (SELECT * FROM s2 ORDER BY visit LIMIT 15)) SELECT pos::INT AS pos, f.id || CASE WHEN parent IS NULL THEN ' is an entry' ELSE ' is called by ' || parent END || ': ' || summary AS line FROM f JOIN esym ON esym.id = f.id")
def explanation_lines(spark: SparkSession, d: str) -> DataFrame:
    """What a model would be told of a subgraph: its first fifteen nodes and the edge to each."""
    nodes = A.event_symbols(spark, d)
    return R.evidence(R.retrieve(nodes, A.event_edges(spark, d), ASKED, 2), nodes)


@query(with_("ev") + ", l AS (SELECT node, user_id, max(ts) AS t FROM ev GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY t DESC, user_id) AS r FROM l), c AS (SELECT node, string_agg(user_id::VARCHAR, ',' ORDER BY r) AS contexts FROM r WHERE r <= 10 GROUP BY node), u AS (SELECT node, count(*) AS n, min(ts) AS first_access, max(ts) AS last_access FROM ev GROUP BY node) SELECT u.*, contexts FROM u JOIN c ON c.node = u.node")
def usage_contexts(spark: SparkSession, d: str) -> DataFrame:
    """Uses of each node: count, first, last, and the last ten distinct contexts, latest first."""
    each = A.events(spark, d).groupBy("node", "user_id").agg(F.count(F.lit(1)).alias("c"), F.min("ts").alias("a"), F.max("ts").alias("b"))
    total = each.groupBy("node").agg(F.sum("c").alias("n"), F.min("a").alias("first_access"), F.max("b").alias("last_access"))
    last = G.top_per(each.select("node", "user_id", "b"), 10, ["node"], F.desc("b"), "user_id")
    last = last.groupBy("node").agg(F.array_sort(F.collect_list(F.struct((-F.unix_micros(F.col("b").cast("timestamp"))).alias("k"), "user_id"))).alias("s"))
    return total.join(last.select("node", F.array_join(F.transform("s", lambda x: x["user_id"].cast("string")), ",").alias("contexts")), "node")


@query("SELECT event_id, regexp_extract('Answer: ' || props || ' done', '\\{[\\s\\S]*\\}') AS json, json_extract_string(props, '$.k') AS k, substr(sha256(event_type || ':' || user_id), 1, 12) AS stable_id FROM events")
def json_salvage(spark: SparkSession, d: str) -> DataFrame:
    """JSON found within a text, from its first brace to its last; and a stable id."""
    text = F.concat(F.lit("Answer: "), "props", F.lit(" done"))
    found = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    return A.load(spark, d, "events").select("event_id", found.alias("json"), F.get_json_object(found, "$.k").alias("k"), F.substring(F.sha2(F.concat_ws(":", "event_type", "user_id"), 256), 1, 12).alias("stable_id"))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IS NULL OR o_custkey = 7")
def ownership_filter(spark: SparkSession, d: str) -> DataFrame:
    """Rows without an owner, or of this one; reaches the scan."""
    return A.load(spark, d, "orders").where("o_custkey is null or o_custkey = 7").select("o_orderkey", "o_custkey")


@query(with_("ev") + " SELECT event_type AS pattern, count(DISTINCT node) AS n_members, count(*) AS n_calls FROM ev GROUP BY event_type HAVING count(DISTINCT node) >= 2")
def pattern_groups(spark: SparkSession, d: str) -> DataFrame:
    """Control-flow pattern groups of two or more members."""
    each = A.events(spark, d).groupBy("event_type", "node").agg(F.count(F.lit(1)).alias("c"))
    return each.groupBy(F.col("event_type").alias("pattern")).agg(F.count(F.lit(1)).alias("n_members"), F.sum("c").alias("n_calls")).where("n_members >= 2")


@query(CO + " SELECT id, left(name, 60) AS name, file, left(repeat(summary || ' ', 20), 160) AS summary FROM cnodes")
def node_briefs(spark: SparkSession, d: str) -> DataFrame:
    """Nodes as lists show them, with 160 characters of their summary."""
    long = F.repeat(F.concat("summary", F.lit(" ")), 20)
    return A.commerce_nodes(spark, d).select("id", "name", "file", F.substring(long, 1, 160).alias("summary"))


@query(CO + " SELECT 'node' AS part, id AS a, complexity AS b FROM cnodes WHERE kind = 'function' UNION ALL SELECT 'edge', src, dst FROM cedges WHERE src IN (SELECT id FROM cnodes WHERE semantic_kind = 'EXPOSES_API')")
def semantic_listing(spark: SparkSession, d: str) -> DataFrame:
    """Nodes that have semantics, and all semantic edges."""
    n = A.commerce_nodes(spark, d)
    semantic = A.commerce_edges(spark, d).join(n.where("semantic_kind = 'EXPOSES_API'").select(F.col("id").alias("src")), "src", "left_semi")
    return n.where("kind = 'function' and complexity is not null").select(F.lit("node").alias("part"), F.col("id").alias("a"), F.col("complexity").alias("b")).union(semantic.select(F.lit("edge"), "src", "dst"))


@query(with_("ev") + ", r AS (SELECT user_id, ts::DATE AS day, node, row_number() OVER (PARTITION BY user_id, ts::DATE ORDER BY ts, event_id) AS k FROM ev), s AS (SELECT string_agg(node, '>' ORDER BY k) AS path FROM r WHERE k <= 2 GROUP BY user_id, day HAVING count(*) >= 2), c AS (SELECT path, count(*) AS n FROM s GROUP BY path) SELECT path, n, split_part(path, ':', 1) || '>' || split_part(split_part(path, '>', 2), ':', 1) AS names FROM c")
def common_paths_named(spark: SparkSession, d: str) -> DataFrame:
    """Paths with their nodes' names; nodes that are gone drop out."""
    paths = L.common_paths(L.first_nodes(A.events(spark, d), ["user_id", F.to_date("ts").alias("day")], "node", ["ts", "event_id"], 2), 1)
    each = paths.select("path", "n", F.posexplode(F.split("path", ">")).alias("k", "id")).join(A.event_nodes(spark, d).select("id", F.col("kind").alias("name")), "id")
    return each.groupBy("path", "n").agg(F.array_sort(F.collect_list(F.struct("k", "name"))).alias("s")).select("path", "n", F.array_join(F.transform("s", lambda x: x["name"]), ">").alias("names"))


@query(CO + _CDEG + " SELECT id, CASE WHEN fan_out > 30 OR criticality = 'critical' OR semantic_kind IN ('EXPOSES_API', 'USES_DB') THEN 'critical' WHEN fan_out > 10 OR criticality = 'high' THEN 'high' WHEN fan_out > 3 OR criticality = 'medium' THEN 'medium' ELSE 'low' END AS risk FROM cd")
def risk_levels(spark: SparkSession, d: str) -> DataFrame:
    """Risk of every node by what is downstream, how critical it is, and its kind."""
    return _cdeg(spark, d).select("id", T.risk(F.col("fan_out"), F.col("criticality"), F.col("semantic_kind")).alias("risk"))
