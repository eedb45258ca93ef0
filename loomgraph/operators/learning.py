"""The learning layer over query logs: usage, terms, paths, analytics, and terms taken from names."""

from __future__ import annotations

import hashlib
import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..storage import written
from . import graph as G


def first_nodes(log: DataFrame, keys: list, node: str, order: list[str], k: int) -> DataFrame:
    """(*keys, path): the first ``k`` nodes of each query, of at least two."""
    names = [f"_k{i}" for i in range(len(keys))]
    rows = log.select(*[(F.col(c) if isinstance(c, str) else c).alias(n) for c, n in zip(keys, names)], F.struct(*order).alias("_o"), F.col(node).alias("_n"))
    top = G.top_per(rows, k, names, "_o").groupBy(*names).agg(F.array_sort(F.collect_list(F.struct("_o", "_n"))).alias("s"))
    return top.where(F.size("s") >= 2).select(*names, F.array_join(F.transform("s", lambda x: x["_n"]), ">").alias("path"))


def common_paths(paths: DataFrame, least: int = 3) -> DataFrame:
    """(path, n) of signatures that occur ``least`` times or more."""
    return paths.groupBy("path").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def analytics(log: DataFrame, k: int = 10) -> DataFrame:
    """One row over queries (term, node, helpful, ms): totals, rate, distinct nodes, mean of positive times, top terms."""
    top = log.groupBy("term").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "term").limit(k)
    top = top.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "term"))), lambda x: F.concat_ws(":", x["term"], -x["m"])), ",").alias("top_terms"))
    total, good = F.count(F.lit(1)), F.sum(F.col("helpful").cast("long"))
    one = log.agg(
        total.alias("total_queries"), F.coalesce(good, F.lit(0)).alias("helpful_queries"), F.round(F.when(total > 0, 100.0 * good / total).otherwise(0.0), 2).alias("helpful_rate"),
        F.countDistinct("node").alias("unique_nodes"), F.round(F.coalesce(F.avg(F.when(F.col("ms") > 0, F.col("ms"))), F.lit(0.0)), 2).alias("avg_response_time_ms"),
    )
    return one.join(F.broadcast(top))  # one row


def term_map(queries: DataFrame, names: DataFrame, most: int = 20) -> DataFrame:
    """(term, frequency, confidence, names) of queries' terms (query, text) and the first five names found (query, pos, name).

    Of the names mapped to a term the ``most`` most frequent are kept, so no list grows with the log.
    """
    each = queries.select("query", F.explode(T.terms(F.col("text"))).alias("term"))
    count = each.groupBy("term").agg(F.count(F.lit(1)).alias("frequency"))
    pair = each.distinct().join(names.where("pos <= 5").select("query", "name"), "query").groupBy("term", "name").agg(F.count(F.lit(1)).alias("c"))
    best = G.top_per(pair, most, ["term"], F.desc("c"), "name").groupBy("term").agg(F.array_sort(F.collect_set("name")).alias("names"))
    return count.join(best, "term", "left").select("term", "frequency", F.least(F.lit(1.0), F.col("frequency") / 10.0).alias("confidence"), F.coalesce("names", F.array().cast("array<string>")).alias("names"))


def seed_terms(names: DataFrame, id_col: str, name: Column, share: float = 0.2) -> DataFrame:
    """(term, df, frequency, confidence): discriminative terms of symbol names before any real query.

    Terms in more than ``share`` of the symbols, and more than one, are left out; each begins at frequency 4.
    """
    spaced = F.translate(name, "_-", "  ")
    each = names.select(F.col(id_col).alias("i"), F.explode(F.array_distinct(T.terms(spaced))).alias("term"))
    df = each.groupBy("term").agg(F.countDistinct("i").alias("df"))
    n = names.agg(F.count(F.lit(1)).alias("n"))
    kept = df.join(F.broadcast(n)).where(F.col("df") <= F.greatest(F.lit(1), F.floor(F.col("n") * share)))  # one row
    return kept.select("term", "df", F.lit(4).alias("frequency"), F.lit(0.4).alias("confidence"))


class QueryLog:
    """Asked questions and the names found for them, appended to a folder that later sessions read on.

    A batch's names are written before its queries, and names count only beside a query, so a batch that was cut off is as if
    it had never begun. ``batch`` is the time of the append.
    """

    QUERIES, NAMES = "query string, text string, batch double", "query string, pos int, name string, batch double"

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        for part, schema in (("queries", self.QUERIES), ("names", self.NAMES)):
            spark.createDataFrame([], schema).write.mode("append").parquet(f"{self.root}/{part}")

    def record(self, queries: DataFrame, names: DataFrame) -> None:
        """Append queries (query, text) and the names found (query, pos, name)."""
        now = F.lit(time.time())
        names.select(F.col("query").cast("string"), F.col("pos").cast("int"), "name", now.alias("batch")).write.mode("append").parquet(f"{self.root}/names")
        queries.select(F.col("query").cast("string"), "text", now.alias("batch")).write.mode("append").parquet(f"{self.root}/queries")

    def ask(self, nodes: DataFrame, edges: DataFrame, question: str, hops: int = 2, learned: tuple[str, ...] = ()) -> tuple[str, DataFrame]:
        """The subgraph of a question (``retrieval.retrieve``) and the id under which it was logged with its first five names."""
        from . import retrieval

        found = written(retrieval.retrieve(nodes, edges, question, hops, learned))
        query = hashlib.sha256(f"{time.time_ns()}\n{question}".encode()).hexdigest()[:16]
        names = found.where("visit < 5").join(nodes.select("id", "name"), "id").select(F.lit(query).alias("query"), (F.col("visit") + 1).alias("pos"), "name")
        self.record(self.spark.createDataFrame([(query, question)], "query string, text string"), names)
        return query, found

    def queries(self) -> DataFrame:
        return self.spark.read.schema(self.QUERIES).parquet(f"{self.root}/queries")

    def names(self) -> DataFrame:
        names = self.spark.read.schema(self.NAMES).parquet(f"{self.root}/names")
        return names.join(self.queries().select("query").distinct(), "query", "left_semi")

    def terms(self, most: int = 20) -> DataFrame:
        """``term_map`` of all that was logged."""
        return term_map(self.queries(), self.names(), most)
