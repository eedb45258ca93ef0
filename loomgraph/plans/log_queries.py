"""Learning, storage, resolution and stateful queries over logs and tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vocabulary as V
from ..operators import graph as G
from ..operators import learning as L
from ..operators import resolve as R
from ..operators import retrieval as R2
from ..operators import stateful as S
from ..storage import shared_dir
from . import adapters as A
from .adapters import with_
from .registry import registry

QUERIES, SQL, query = registry(__name__)


EV = with_("ev")


@query(EV + " SELECT node, count(*) AS n, count(DISTINCT user_id) AS users FROM ev GROUP BY node ORDER BY n DESC, node LIMIT 10")
def hot_nodes(spark: SparkSession, d: str) -> DataFrame:
    return A.events(spark, d).groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("user_id").alias("users")).orderBy(F.desc("n"), "node").limit(10)


_SESSION = EV + ", r AS (SELECT user_id, ts::DATE AS day, event_type, row_number() OVER (PARTITION BY user_id, ts::DATE ORDER BY ts, event_id) AS k FROM ev), s AS (SELECT user_id, day, string_agg(event_type, '>' ORDER BY k) AS path, count(*) AS n FROM r WHERE k <= 5 GROUP BY ALL HAVING count(*) >= 2)"


@query(_SESSION + " SELECT path, count(*) AS n FROM s GROUP BY path HAVING count(*) >= 3")
def common_paths(spark: SparkSession, d: str) -> DataFrame:
    """Signatures of queries (a user's day: the first five of at least two nodes) that occur three times or more."""
    return L.common_paths(L.first_nodes(A.events(spark, d), ["user_id", F.to_date("ts").alias("day")], "event_type", ["ts", "event_id"], 5), 3)


@query("WITH s AS (SELECT event_type AS a, lead(event_type) OVER w AS b, lead(event_type, 2) OVER w AS c FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) SELECT a || '>' || b || '>' || c AS path, count(*) AS n FROM s WHERE c IS NOT NULL GROUP BY 1 HAVING count(*) >= 3")
def event_triples(spark: SparkSession, d: str) -> DataFrame:
    """Three consecutive event types of a user that occur three times or more."""
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    s = A.load(spark, d, "events").select(F.col("event_type").alias("a"), F.lead("event_type").over(w).alias("b"), F.lead("event_type", 2).over(w).alias("c")).where("c is not null")
    return s.groupBy(F.concat_ws(">", "a", "b", "c").alias("path")).agg(F.count(F.lit(1)).alias("n")).where("n >= 3")


@query(EV + " SELECT count(*) AS total_queries, sum((event_type = 'purchase')::INT)::BIGINT AS helpful_queries, round(100.0 * sum((event_type = 'purchase')::INT) / count(*), 2)::DOUBLE AS helpful_rate, count(DISTINCT node) AS unique_nodes, round(avg(CASE WHEN value > 0 THEN value END), 2) AS avg_response_time_ms, (SELECT string_agg(node || ':' || n, ',' ORDER BY n DESC, node) FROM (SELECT node, count(*) AS n FROM ev GROUP BY node ORDER BY n DESC, node LIMIT 10)) AS top_terms FROM ev")
def query_analytics(spark: SparkSession, d: str) -> DataFrame:
    """Totals, helpful rate, distinct nodes, mean latency over calls that took any time, and the ten most queried terms."""
    e = A.events(spark, d).select(F.col("node").alias("term"), "node", (F.col("event_type") == "purchase").alias("helpful"), F.col("value").alias("ms"))
    return L.analytics(e)


_TERMS = "terms AS (SELECT conv_id, turn, unnest([x FOR x IN string_split(trim(regexp_replace(regexp_replace(lower(text), '[^\\p{L}\\p{N}_\\s]', ' ', 'g'), '\\s+', ' ', 'g')), ' ') IF length(x) > 2 AND x NOT IN (" + ", ".join(f"'{w}'" for w in V.STOP) + ")]) AS term FROM conversations WHERE role = 'user')"


def _terms(spark: SparkSession, d: str) -> DataFrame:
    return A.load(spark, d, "conversations").where("role = 'user'").select("conv_id", "turn", F.explode(T.terms(F.col("text"))).alias("term"))


@query(f"WITH {_TERMS} SELECT term, count(*) AS n, least(1.0, count(*) / 10.0)::DOUBLE AS confidence FROM terms GROUP BY term")
def term_frequency(spark: SparkSession, d: str) -> DataFrame:
    return _terms(spark, d).groupBy("term").agg(F.count(F.lit(1)).alias("n")).select("term", "n", F.least(F.lit(1.0), F.col("n") / 10.0).alias("confidence"))


@query(f"WITH {_TERMS}, df AS (SELECT term, count(DISTINCT conv_id) AS df FROM terms GROUP BY term) SELECT term, df FROM df WHERE df <= greatest(1, 0.2 * (SELECT count(DISTINCT conv_id) FROM conversations))")
def term_seed_df_filter(spark: SparkSession, d: str) -> DataFrame:
    df = _terms(spark, d).groupBy("term").agg(F.countDistinct("conv_id").alias("df"))
    n = A.load(spark, d, "conversations").agg(F.countDistinct("conv_id").alias("n"))
    return df.crossJoin(F.broadcast(n)).where("df <= greatest(1, 0.2 * n)").select("term", "df")  # one row


_MAP = f"{_TERMS}, cnt AS (SELECT term, count(*) AS frequency FROM terms GROUP BY term), nm AS (SELECT DISTINCT conv_id AS query, turn AS pos, lower(split_part(text, ' ', 1)) AS name FROM conversations WHERE role = 'assistant' AND turn <= 5), pr AS (SELECT term, name, count(*) AS c FROM (SELECT DISTINCT conv_id, term FROM terms) t JOIN nm ON nm.query = t.conv_id GROUP BY ALL), tm AS (SELECT cnt.term, frequency, least(1.0, frequency / 10.0)::DOUBLE AS confidence, names FROM cnt LEFT JOIN (SELECT term, list_sort(list(DISTINCT name)) AS names FROM (SELECT *, row_number() OVER (PARTITION BY term ORDER BY c DESC, name) AS r FROM pr) WHERE r <= 20 GROUP BY term) USING (term))"


def _learned(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    c = A.load(spark, d, "conversations")
    queries = c.where("role = 'user'").select(F.col("conv_id").alias("query"), "text")
    names = c.where("role = 'assistant' and turn <= 5").select(F.col("conv_id").alias("query"), F.lit(1).alias("pos"), F.lower(F.split("text", " ")[0]).alias("name"))
    return queries, L.term_map(queries, names)


@query(f"WITH {_MAP} SELECT term, frequency, confidence, coalesce(array_to_string(names, '|'), '') AS names FROM tm")
def term_map(spark: SparkSession, d: str) -> DataFrame:
    """Terms of queries with frequency, confidence and the names found for them."""
    return _learned(spark, d)[1].withColumn("names", F.array_join("names", "|"))


@query(f"WITH {_MAP} SELECT term, frequency, confidence, coalesce(array_to_string(names, '|'), '') AS names FROM tm")
def logged_terms(spark: SparkSession, d: str) -> DataFrame:
    """The same from a log that two sessions appended to, half of the conversations each."""
    c, root = A.load(spark, d, "conversations"), shared_dir(spark)
    for k in range(2):
        part = c.where(F.pmod(F.xxhash64("conv_id"), F.lit(2)) == k)
        asked = part.where("role = 'user'").select(F.col("conv_id").alias("query"), "text")
        found = part.where("role = 'assistant' and turn <= 5").select(F.col("conv_id").alias("query"), F.lit(1).alias("pos"), F.lower(F.split("text", " ")[0]).alias("name"))
        L.QueryLog(spark, root).record(asked, found)
    return L.QueryLog(spark, root).terms().withColumn("names", F.array_join("names", "|"))


@query(f"WITH {_MAP}, u AS (SELECT conv_id, term, min((turn, pos)) AS pos FROM (SELECT conv_id, turn, unnest(ts) AS term, unnest(range(len(ts))) AS pos FROM (SELECT conv_id, turn, list(term) AS ts FROM terms GROUP BY ALL)) GROUP BY ALL), x AS (SELECT conv_id, pos, n, i FROM (SELECT conv_id, pos, unnest(names) AS n, unnest(range(len(names))) AS i FROM u JOIN tm USING (term) WHERE confidence > 0.1)), y AS (SELECT conv_id, n, min((pos, i)) AS p FROM x GROUP BY ALL) SELECT conv_id, array_to_string(list_slice(list(n ORDER BY p), 1, 10), '|') AS names FROM y GROUP BY conv_id")
def term_suggest(spark: SparkSession, d: str) -> DataFrame:
    """Ten names for each conversation's queries, from the terms whose confidence is over 0.1, in the terms' order."""
    _, learned = _learned(spark, d)
    asked = A.load(spark, d, "conversations").where("role = 'user'").select(F.col("conv_id").alias("query"), "turn", F.posexplode(T.terms(F.col("text"))).alias("k", "term"))
    first = asked.groupBy("query", "term").agg(F.min(F.struct("turn", "k")).alias("pos"))
    return R2.suggestions(first, learned).select(F.col("query").alias("conv_id"), F.array_join("names", "|").alias("names"))


@query("WITH p AS (SELECT p_partkey, unnest(list_distinct([x FOR x IN string_split(p_name || ' ' || lower(p_type), ' ') IF length(x) > 2 AND x NOT IN (" + ", ".join(f"'{w}'" for w in V.STOP) + ")])) AS term FROM part) SELECT term, count(*) AS df, 4 AS frequency, 0.4::DOUBLE AS confidence FROM p GROUP BY term HAVING count(*) <= greatest(1, floor(0.2 * (SELECT count(*) FROM part)))")
def seeded_terms(spark: SparkSession, d: str) -> DataFrame:
    """Discriminative terms of names, before any query."""
    return L.seed_terms(A.load(spark, d, "part"), "p_partkey", F.concat_ws("_", F.replace("p_name", F.lit(" "), F.lit("-")), "p_type"))


@query("WITH RECURSIVE e AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k, CASE event_type WHEN 'purchase' THEN 0.1 WHEN 'signup' THEN 0.2 ELSE -0.1 END::DOUBLE AS d FROM events WHERE event_type IN ('purchase', 'signup', 'error')), f AS (SELECT user_id, k, greatest(0, least(1, d)) AS s FROM e WHERE k = 1 UNION ALL SELECT e.user_id, e.k, greatest(0, least(1, s + d)) FROM f JOIN e ON e.user_id = f.user_id AND e.k = f.k + 1) SELECT user_id, round(arg_max(s, k), 6) AS score FROM f GROUP BY user_id")
def relevance_clamped_fold(spark: SparkSession, d: str) -> DataFrame:
    """Helpful +0.1, a correction (signup) +0.2, unhelpful -0.1, clamped after each."""
    delta = F.when(F.col("event_type") == "purchase", 0.1).when(F.col("event_type") == "signup", 0.2).when(F.col("event_type") == "error", -0.1)
    return S.clamped_fold(A.load(spark, d, "events"), "user_id", ["ts", "event_id"], delta).select("user_id", F.round("score", 6).alias("score"))


@query(EV + ", u AS (SELECT user_id, count(*) AS n, least(1, avg(value) / 50) AS relevance, CASE user_id % 4 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' WHEN 2 THEN 'high' ELSE 'critical' END AS level FROM ev GROUP BY user_id) SELECT user_id, level, CASE WHEN n > 10 AND relevance > 0.7 THEN CASE level WHEN 'low' THEN 'medium' WHEN 'medium' THEN 'high' ELSE 'critical' END ELSE level END AS raised FROM u")
def importance_bump(spark: SparkSession, d: str) -> DataFrame:
    """Criticality one level up after over ten accesses at a relevance over 0.7."""
    u = A.load(spark, d, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.least(F.lit(1.0), F.avg("value") / 50).alias("relevance"))
    levels = F.array(*map(F.lit, V.CRITICALITY))
    u = u.withColumn("level", F.get(levels, (F.col("user_id") % 4).cast("int")))
    return u.select("user_id", "level", T.raised(F.col("level"), F.col("n"), F.col("relevance")).alias("raised"))


@query("SELECT event_id, CASE WHEN value >= 4 THEN 'helpful' WHEN value <= 2 THEN 'unhelpful' ELSE 'neutral' END AS rating FROM events")
def rating_normalise(spark: SparkSession, d: str) -> DataFrame:
    return A.load(spark, d, "events").select("event_id", T.rating(F.col("value")).alias("rating"))


@query("SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) WHERE r <= 3")
def last_three_turns(spark: SparkSession, d: str) -> DataFrame:
    return G.top_per(A.load(spark, d, "conversations").select("conv_id", "turn", "role"), 3, ["conv_id"], F.desc("turn"))


@query("SELECT conv_id, string_agg(role || ': ' || CASE role WHEN 'assistant' THEN left(text, 200) ELSE text END, ' | ' ORDER BY turn) AS context FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) WHERE r <= 2 GROUP BY conv_id")
def prior_context_string(spark: SparkSession, d: str) -> DataFrame:
    two = G.top_per(A.load(spark, d, "conversations"), 2, ["conv_id"], F.desc("turn"))
    parts = F.array_sort(F.collect_list(F.struct("turn", F.concat(F.col("role"), F.lit(": "), F.when(F.col("role") == "assistant", F.substring("text", 1, 200)).otherwise(F.col("text"))).alias("s"))))
    return two.groupBy("conv_id").agg(F.array_join(F.transform(parts, lambda x: x["s"]), " | ").alias("context"))


@query("SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 60 SECONDS PRECEDING AND CURRENT ROW) AS n FROM events")
def trailing_rate_window(spark: SparkSession, d: str) -> DataFrame:
    by = W.partitionBy("user_id").orderBy(F.col("ts").cast("timestamp").cast("double")).rangeBetween(-60, 0)
    return A.load(spark, d, "events").select("event_id", F.count(F.lit(1)).over(by).alias("n"))


def _greedy_sql(key: str, limit: int, seconds: int) -> str:
    """The kept times of each key, event after event."""
    return (
        f"WITH RECURSIVE e AS (SELECT {key}, event_id, epoch_us(ts) / 1000000.0::DOUBLE AS t, row_number() OVER (PARTITION BY {key} ORDER BY ts, event_id) AS k FROM events), "
        f"f AS (SELECT {key}, event_id, k, [t] AS kept, true AS allowed FROM e WHERE k = 1 UNION ALL SELECT e.{key}, e.event_id, e.k, CASE WHEN len(list_filter(kept, lambda x: x > t - {seconds})) < {limit} THEN list_append(list_filter(kept, lambda x: x > t - {seconds}), t) ELSE list_filter(kept, lambda x: x > t - {seconds}) END, len(list_filter(kept, lambda x: x > t - {seconds})) < {limit} FROM f JOIN e ON e.{key} = f.{key} AND e.k = f.k + 1) "
        f"SELECT {key}, event_id, allowed FROM f"
    )


@query(_greedy_sql("user_id", 6, 3600))
def rate_limit_greedy(spark: SparkSession, d: str) -> DataFrame:
    return S.greedy_limit(A.load(spark, d, "events"), "user_id", "ts", "event_id", 6, 3600.0)


@query(_greedy_sql("event_type", 300, 86400))
def daily_budget_by_type(spark: SparkSession, d: str) -> DataFrame:
    """At most 300 events of a type in any 24 hours."""
    return S.greedy_limit(A.load(spark, d, "events"), "event_type", "ts", "event_id", 300, 86400.0)


@query(_greedy_sql("event_type", 300, 86400).replace("SELECT event_type, event_id, epoch_us", "SELECT 'all' AS event_type, event_id, epoch_us").replace("PARTITION BY event_type ORDER", "ORDER").replace("SELECT event_type, event_id, allowed FROM f", "SELECT event_id, allowed FROM f"))
def daily_budget_greedy(spark: SparkSession, d: str) -> DataFrame:
    """One budget of all events: at most 300 in any 24 hours."""
    return S.one_limit(A.load(spark, d, "events"), "ts", "event_id", 300, 86400.0)


_BREAK = """WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) / 1000000.0::DOUBLE AS t, event_type = 'error' AS fail, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
f AS (SELECT user_id, event_id, 1::BIGINT AS k, 'closed' AS state, fail::INT AS bad, 0 AS good, 0.0::DOUBLE AS since FROM e WHERE k = 1 UNION ALL
SELECT user_id, event_id, k, CASE WHEN now = 'open' THEN 'open' WHEN fail AND (now = 'half_open' OR bad + 1 >= 5) THEN 'open' WHEN NOT fail AND now = 'half_open' AND good + 1 >= 3 THEN 'closed' ELSE now END,
CASE WHEN now = 'open' THEN bad WHEN fail THEN bad + 1 WHEN now = 'half_open' AND good + 1 >= 3 THEN 0 ELSE greatest(0, bad - 1) END, CASE WHEN now = 'open' OR fail THEN good ELSE good + 1 END, CASE WHEN now <> 'open' AND fail AND (now = 'half_open' OR bad + 1 >= 5) THEN t ELSE since END
FROM (SELECT e.*, bad, since, CASE WHEN state = 'open' AND t - since >= 60 THEN 'half_open' ELSE state END AS now, CASE WHEN state = 'open' AND t - since >= 60 THEN 0 ELSE good END AS good FROM f JOIN e ON e.user_id = f.user_id AND e.k = f.k + 1))
SELECT user_id, event_id, state FROM f"""


@query(_BREAK)
def circuit_state(spark: SparkSession, d: str) -> DataFrame:
    return S.breaker(A.load(spark, d, "events"), "user_id", "ts", "event_id", F.col("event_type") == "error")


@query("WITH RECURSIVE e AS (SELECT user_id, event_type, event_id, epoch_us(ts) / 1000000.0::DOUBLE AS t, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS k FROM events), f AS (SELECT user_id, event_type, event_id, k, t AS last, false AS reused FROM e WHERE k = 1 UNION ALL SELECT e.user_id, e.event_type, e.event_id, e.k, CASE WHEN t - last <= 3600 THEN last ELSE t END, t - last <= 3600 FROM f JOIN e ON e.user_id = f.user_id AND e.event_type = f.event_type AND e.k = f.k + 1) SELECT user_id, event_type, event_id, reused FROM f")
def request_dedup_ttl(spark: SparkSession, d: str) -> DataFrame:
    return S.reuse(A.load(spark, d, "events"), ["user_id", "event_type"], "ts", "event_id", 3600.0)


# --- store


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderdate >= TIMESTAMP '2001-01-01'")
def scan_light_projection(spark: SparkSession, d: str) -> DataFrame:
    return A.load(spark, d, "orders").where("o_orderdate >= timestamp '2001-01-01'").select("o_orderkey", "o_orderstatus")


@query("SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS newest FROM orders GROUP BY o_custkey")
def newest_graph_per_key(spark: SparkSession, d: str) -> DataFrame:
    return A.load(spark, d, "orders").groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("newest"))


@query("SELECT user_id, event_type AS key, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY ALL")
def kv_latest(spark: SparkSession, d: str) -> DataFrame:
    return A.load(spark, d, "events").groupBy("user_id", F.col("event_type").alias("key")).agg(F.max_by("value", F.struct("ts", "event_id")).alias("value"))


@query("SELECT o_orderkey FROM orders WHERE o_orderdate < (SELECT max(o_orderdate) FROM orders) - INTERVAL 1000 DAYS")
def ttl_expired(spark: SparkSession, d: str) -> DataFrame:
    o = A.load(spark, d, "orders")
    return o.crossJoin(F.broadcast(o.agg(F.max("o_orderdate").alias("m")))).where("o_orderdate < m - interval 1000 days").select("o_orderkey")  # one row


@query("SELECT l_orderkey, l_linenumber FROM lineitem ANTI JOIN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') o ON o_orderkey = l_orderkey")
def cascade_delete_survivors(spark: SparkSession, d: str) -> DataFrame:
    gone = A.load(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return A.load(spark, d, "lineitem").select("l_orderkey", "l_linenumber").join(gone, "l_orderkey", "left_anti")


@query("WITH a AS (SELECT page_id AS id, md5(html) AS h FROM pages), b AS (SELECT doc_id AS id, md5(text) AS h FROM documents) SELECT coalesce(a.id, b.id) AS id, CASE WHEN a.h IS NULL THEN 'added' WHEN b.h IS NULL THEN 'removed' ELSE 'changed' END AS change FROM a FULL JOIN b ON a.id = b.id WHERE a.h IS DISTINCT FROM b.h")
def manifest_diff_changed(spark: SparkSession, d: str) -> DataFrame:
    """Two manifests compared by content hash: pages as the old snapshot, documents as the new one."""
    a = A.load(spark, d, "pages").select(F.col("page_id").alias("id"), F.md5("html").alias("a"))
    b = A.load(spark, d, "documents").select(F.col("doc_id").alias("id"), F.md5("text").alias("b"))
    change = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").otherwise("changed")
    return a.join(b, "id", "full_outer").where(~F.col("a").eqNullSafe(F.col("b"))).select("id", change.alias("change"))


# --- resolution


@query("WITH n AS (SELECT p_name, min(p_partkey) AS p_partkey FROM part GROUP BY p_name), ask AS (SELECT upper(p_name) AS q FROM n UNION SELECT p_name FROM n UNION SELECT left(p_name, 3) FROM n UNION SELECT 'nowhere'), c AS (SELECT q, p_partkey, CASE WHEN q = p_name THEN 0 WHEN lower(q) = lower(p_name) THEN 1 ELSE 2 END AS tier FROM ask JOIN n ON starts_with(lower(p_name), lower(q))) SELECT q, arg_min(p_partkey, (tier, p_partkey)) AS p_partkey, min(tier)::INT AS tier FROM c GROUP BY q")
def name_resolve_tiers(spark: SparkSession, d: str) -> DataFrame:
    """Names to nodes: exact, then without case, then by prefix; the first node of the best tier."""
    part = A.load(spark, d, "part").select("p_partkey", "p_name")
    n = part.groupBy("p_name").agg(F.min("p_partkey").alias("p_partkey"))
    ask = n.select(F.upper("p_name").alias("q")).union(n.select("p_name")).union(n.select(F.substring("p_name", 1, 3))).union(spark.createDataFrame([("nowhere",)], "q string")).distinct()
    return R.by_name(ask, n.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))).select("q", F.col("id").alias("p_partkey"), "tier")


@query("WITH s AS (SELECT s_name AS name, 's' || s_suppkey AS id, s_nationkey AS f FROM supplier), c AS (SELECT c_custkey, c_nationkey, 'Supplier#' || lpad((c_custkey % 150)::VARCHAR, 9, '0') AS target FROM customer), l AS (SELECT f, name, max(id) AS id FROM s GROUP BY ALL), u AS (SELECT name, min(id) AS id FROM s GROUP BY name HAVING count(*) = 1) SELECT c_custkey, coalesce(l.id, u.id) AS target, CASE WHEN l.id IS NOT NULL THEN 0.8 ELSE 0.65 END::DOUBLE AS confidence FROM c LEFT JOIN l ON l.name = target AND l.f = c_nationkey LEFT JOIN u ON u.name = target WHERE l.id IS NOT NULL OR u.id IS NOT NULL")
def symbol_resolution_tiers(spark: SparkSession, d: str) -> DataFrame:
    nodes = A.load(spark, d, "supplier").select(F.concat(F.col("s_nationkey").cast("string"), F.lit("::"), "s_name", F.lit("|s"), "s_suppkey").alias("id"), F.col("s_name").alias("name"), F.lit("function").alias("kind"), F.col("s_nationkey").cast("string").alias("path"))
    c = A.load(spark, d, "customer")
    edges = c.select(F.concat(F.col("c_nationkey").cast("string"), F.lit("::c"), "c_custkey").alias("id"), F.concat(F.lit("Supplier#"), F.lpad((F.col("c_custkey") % 150).cast("string"), 9, "0")).alias("target"), F.lit("").alias("receiver"), F.col("c_custkey").alias("line"))
    got = R.resolve_calls(edges, nodes)
    return got.select(F.col("line").alias("c_custkey"), F.element_at(F.split("target_id", r"\|"), -1).alias("target"), "confidence")


@query("SELECT 'external::module::' || host AS id, count(*) AS n FROM (SELECT regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host FROM pages) WHERE host <> '' GROUP BY host")
def external_upsert(spark: SparkSession, d: str) -> DataFrame:
    host = F.regexp_extract("url", "^[a-z]+://([^/?#]*)", 1)
    return A.load(spark, d, "pages").select(host.alias("h")).where("h <> ''").groupBy("h").agg(F.count(F.lit(1)).alias("n")).select(F.concat(F.lit("external::module::"), "h").alias("id"), "n")


@query("SELECT l_partkey, l_suppkey, l_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY l_orderkey, l_linenumber) AS r FROM lineitem) WHERE r = 1")
def edge_dedupe_first(spark: SparkSession, d: str) -> DataFrame:
    return R.first_per(A.load(spark, d, "lineitem").select("l_partkey", "l_suppkey", "l_orderkey", "l_linenumber"), ["l_partkey", "l_suppkey"], "l_orderkey", "l_linenumber").drop("l_linenumber")


@query("SELECT p_partkey, CASE WHEN r > 1 THEN p_name || '#' || p_partkey ELSE p_name END AS id FROM (SELECT *, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS r FROM part)")
def id_disambiguate(spark: SparkSession, d: str) -> DataFrame:
    p = A.load(spark, d, "part").select("p_partkey", F.col("p_name").alias("id"))
    return R.disambiguate(p, "id", "p_partkey")


@query("SELECT o_orderkey, CASE WHEN c_custkey IS NULL THEN o_totalprice ELSE o_totalprice * 2 END AS o_totalprice FROM orders LEFT JOIN (SELECT c_custkey FROM customer WHERE c_acctbal < 0) ON c_custkey = o_custkey")
def incremental_merge(spark: SparkSession, d: str) -> DataFrame:
    """Fresh rows of changed keys (customers in debt) replace the stored ones."""
    o = A.load(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    changed = A.load(spark, d, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    new = o.join(changed, "o_custkey", "left_semi").withColumn("o_totalprice", F.col("o_totalprice") * 2)
    return R.merge(o, new, changed, "o_custkey").select("o_orderkey", "o_totalprice")
