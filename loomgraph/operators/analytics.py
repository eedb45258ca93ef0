"""Structural analytics of a call graph: unused code, risks, central nodes, couplings, roll-ups.

Nodes have id, name, file, kind, type, complexity, criticality, semantic_kind and decorators; edges src and dst.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vocabulary as V
from ..storage import dealt
from . import graph as G

LEVELS = {name: k for k, name in enumerate(V.COMPLEXITY)} | {name: k for k, name in enumerate(V.CRITICALITY)}


def call_graph(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Code symbols, and the distinct pairs of calls among them; edges may have relationship and type."""
    keep = nodes.where(T.is_code_symbol(F.col("kind"), F.col("type")))
    if {"relationship", "type"} <= set(edges.columns):
        edges = edges.where(T.is_invocation(F.col("relationship"), F.col("type")))
    return keep, G.induced(dealt(edges.select("src", "dst"), "src").distinct(), keep).select("src", "dst")  # distinct while a task has a fixed share of them


def with_degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return nodes.join(G.degrees(nodes, edges).select("id", F.col("in_degree").alias("fan_in"), F.col("out_degree").alias("fan_out")), "id")


def dead_code(nodes: DataFrame, edges: DataFrame, most: int = 50) -> DataFrame:
    """Functions that nothing calls and nothing else explains: entries, tests, APIs, consumers and decorated ones stay."""
    name, path = F.lower("name"), F.lower("file")
    unused = (F.col("kind") != "type") & (F.col("type") != "class") & (F.col("fan_in") == 0)
    known = name.isin(*V.ENTRY_NAMES) | F.col("name").startswith("test") | path.contains("test")
    used = F.col("semantic_kind").isin("EXPOSES_API", "CONSUMES_EVENT") | (F.coalesce("decorators", F.lit("")) != "")
    return with_degrees(nodes, edges).where(unused & ~known & ~F.coalesce(used, F.lit(False))).orderBy("id").limit(most).select("id", "name", "file")


def high_risk(nodes: DataFrame, edges: DataFrame, most: int = 20) -> DataFrame:
    """Nodes with two or more of: ten callees, fifteen callers, high complexity; by degree."""
    reasons = F.array_compact(F.array(
        F.when(F.col("fan_out") >= 10, F.concat(F.lit("large dependency fan-out ("), "fan_out", F.lit(")"))), F.when(F.col("fan_in") >= 15, F.concat(F.lit("heavily depended upon ("), "fan_in", F.lit(" callers)"))),
        F.when(F.col("complexity").isin("high", "very_high"), F.concat("complexity", F.lit(" complexity")))))
    found = with_degrees(nodes, edges).withColumn("reasons", reasons).where(F.size("reasons") >= 2)
    return found.orderBy(F.desc(F.col("fan_in") + F.col("fan_out")), "id").limit(most).select("id", "name", "file", "fan_in", "fan_out", F.array_join("reasons", "; ").alias("reasons"))


def node_metrics(nodes: DataFrame, edges: DataFrame, rank: DataFrame, between: DataFrame) -> DataFrame:
    """Every node's PageRank, degrees, betweenness, complexity and criticality."""
    out = G.degrees(nodes, edges).join(rank, "id", "left").join(between, "id", "left")
    rest = nodes.select("id", *[c for c in ("name", "file", "complexity", "criticality") if c in nodes.columns])
    return rest.join(out.na.fill(0.0, ["rank", "betweenness"]), "id")


def god_nodes(metrics: DataFrame, most: int = 20) -> DataFrame:
    """The most central by 100 PageRank + 0.5 callers + 0.25 callees + 50 betweenness."""
    score = 100 * F.col("rank") + 0.5 * F.col("in_degree") + 0.25 * F.col("out_degree") + 50 * F.col("betweenness")
    top = metrics.withColumn("s", F.round(score, 9)).orderBy(F.desc("s"), "id").limit(most)
    return top.select("id", F.round("s", 3).alias("score"), F.round("rank", 5).alias("pagerank"), "in_degree", "out_degree", F.round("betweenness", 5).alias("betweenness"))


def worst(column: str, scale: tuple[str, ...]):
    """The highest of a column's ordinal values in a group."""
    level = F.lit(None)
    for k, name in enumerate(scale):
        level = F.when(F.col(column) == name, F.lit(k)).otherwise(level)
    return F.max_by(column, level)


def file_rollup(metrics: DataFrame) -> DataFrame:
    """Sums of PageRank and degrees of each file, and its worst complexity and criticality."""
    return metrics.groupBy("file").agg(
        F.round(F.sum("rank"), 5).alias("pagerank"), F.sum("in_degree").alias("fan_in"), F.sum("out_degree").alias("fan_out"),
        worst("complexity", V.COMPLEXITY).alias("complexity"), worst("criticality", V.CRITICALITY).alias("criticality"),
    )


def heat(metrics: DataFrame) -> DataFrame:
    """(id, rank_ratio, fan_ratio): values against the whole graph's largest."""
    fan = F.col("in_degree") + F.col("out_degree")
    top = metrics.agg(F.max("rank").alias("r"), F.max(fan).alias("f"))
    ratio = lambda x, m: F.when(F.col(m) > 0, x / F.col(m)).otherwise(F.lit(0.0))
    return metrics.join(F.broadcast(top)).select("id", ratio(F.col("rank"), "r").alias("rank_ratio"), ratio(fan, "f").alias("fan_ratio"))  # one row


def bridges(nodes: DataFrame, edges: DataFrame, most: int = 15) -> DataFrame:
    """Nodes whose loss splits the undirected graph, by degree."""
    cut = G.articulation_points(nodes, edges)
    found = G.degrees(nodes, edges).join(cut, "id", "left_semi").select("id", (F.col("in_degree") + F.col("out_degree")).alias("degree"))
    return found.orderBy(F.desc("degree"), "id").limit(most)


def couplings(ends: DataFrame, most: int = 15) -> DataFrame:
    """Directory pairs joined by at most two calls, fewest first; ``ends``: src, dst, sd, td."""
    pairs = ends.where("sd <> td").groupBy("sd", "td").agg(F.count(F.lit(1)).alias("n"), F.min(F.concat_ws(">", "src", "dst")).alias("example"))
    return pairs.where("n <= 2").orderBy("n", "sd", "td").limit(most)


def analytics(nodes: DataFrame, edges: DataFrame) -> dict[str, DataFrame]:
    """All of the analytics over one call graph, each a lazy table."""
    from ..storage import written

    nodes, edges = call_graph(nodes, edges)
    edges = written(edges)
    metrics = written(node_metrics(nodes, edges, G.pagerank(nodes, edges), G.betweenness(nodes, edges, most_sources=800)))
    at = nodes.select("id", T.top_directory(F.col("file")).alias("dir"))
    ends = edges.join(at.toDF("src", "sd"), "src").join(at.toDF("dst", "td"), "dst")
    return {
        "god_nodes": god_nodes(metrics), "bridges": bridges(nodes, edges), "dead_code": dead_code(nodes, edges), "high_risk": high_risk(nodes, edges), "surprising_couplings": couplings(ends), "node_metrics": metrics, "file_metrics": file_rollup(metrics),
        "cycles": G.cycles(edges, enough=25).orderBy("length", "path").limit(25), "stats": nodes.agg(F.count(F.lit(1)).alias("callable_nodes")).join(edges.agg(F.count(F.lit(1)).alias("call_edges"))),
    }
