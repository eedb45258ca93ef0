"""A question to a grounded subgraph: synonyms, TF-IDF over node fields, shortlist, rerank, seeds, bounded traversal.

A node table has id, name, summary, file (its path) and intent. Only the question's words reach a shuffle.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vocabulary as V
from . import graph as G

#: Weights of a node's fields.
FIELDS = {"name": 3.0, "summary": 1.5, "file": 0.5, "intent": 1.0}
SHORTLIST, RERANKED, BEST = 30, 10, 5


def question_words(question: str) -> list[str]:
    """The question's identifier tokens (as ``T.tokens``) and their synonyms, sorted.

    A token of five characters or more also stands for keys that begin with it or that it begins with.
    """
    own = [t.lower() for t in re.findall(r"[A-Za-z][a-z0-9]*|[0-9]+", question) if len(t) > 1]
    found = set(own)
    for t in own:
        found.update(V.SYNONYMS.get(t, ()))
        for key, words in V.SYNONYMS.items():
            if len(t) >= 5 and (key.startswith(t) or t.startswith(key)):
                found.update((key, *words))
    return sorted(found)


def rerank_words(question: str) -> list[str]:
    return sorted({t.lower() for t in re.split(r"\W+", question) if len(t) > 2})


def scores(nodes: DataFrame, question: str) -> DataFrame:
    """(id, score) of nodes that share a word with the question: field weight times IDF, each word once a field.

    IDF is ln((N + 1) / (df + 1)) + 1 over name, summary and path of all nodes; a word in intents alone counts 1.
    """
    asked = F.array(*[F.lit(w) for w in question_words(question)]) if question_words(question) else F.array().cast("array<string>")
    n = nodes.agg(F.count(F.lit(1)).alias("n")).first()["n"]

    def field(column: str, weight: float):
        return F.transform(F.array_intersect(T.tokens(F.col(column)), asked), lambda t: F.struct(t.alias("t"), F.lit(weight).alias("w"), F.lit(column != "intent").alias("doc")))

    parts = [field(c, w) for c, w in FIELDS.items()]
    hits = nodes.select("id", F.explode(F.concat(*parts)).alias("x")).select("id", "x.*")
    df = hits.where("doc").groupBy("t").agg(F.countDistinct("id").alias("df"))
    idf = F.broadcast(df.select("t", (F.log((n + 1.0) / (F.col("df") + 1)) + 1).alias("idf")))  # at most the question's words
    return hits.join(idf, "t", "left").groupBy("id").agg(F.sum(F.col("w") * F.coalesce("idf", F.lit(1.0))).alias("score"))


def shortlist(nodes: DataFrame, question: str, k: int = SHORTLIST) -> DataFrame:
    """The ``k`` best nodes with ``pos`` from 1: by score, then by id downwards; unscored nodes come last."""
    best = nodes.join(scores(nodes, question), "id", "left").na.fill(0.0, ["score"]).withColumn("score", F.round("score", 9))
    best = best.orderBy(F.desc("score"), F.desc("id")).limit(k)
    return best.withColumn("pos", F.row_number().over(W.orderBy(F.desc("score"), F.desc("id"))))  # k rows


def keyword_score(name, summary, words: list[str]):
    """1.5 for each of the words within the name and 1 for each within the summary."""
    return sum((F.when(F.lower(name).contains(w), 1.5).otherwise(0.0) + F.when(F.lower(summary).contains(w), 1.0).otherwise(0.0) for w in words), F.lit(0.0))


def seeds(nodes: DataFrame, question: str, learned: list[str] | tuple[str, ...] = ()) -> DataFrame:
    """(id, pos) of entry nodes: reranked names of the shortlist, then learned names in it, then the best scored five."""
    top = shortlist(nodes, question)
    again = keyword_score(F.col("name"), F.substring(F.coalesce("summary", F.lit("")), 1, 80), rerank_words(question))
    top = top.select("id", "name", "score", "pos", again.alias("again"))
    named = top.groupBy("name").agg(F.max("again").alias("again")).where("again > 0").orderBy(F.desc("again"), F.desc("name")).limit(RERANKED)
    named = named.select("name", F.row_number().over(W.orderBy(F.desc("again"), F.desc("name"))).alias("rank"))  # ten rows
    taught = F.array_position(F.array(*map(F.lit, learned)), F.col("name")) if learned else F.lit(0).cast("long")
    rank = F.coalesce(F.col("rank").cast("long"), F.when(taught > 0, taught + RERANKED), F.when((F.col("pos") <= BEST) & (F.col("score") > 0), F.lit(1 << 20)))
    chosen = top.join(F.broadcast(named), "name", "left").withColumn("rank", rank).where("rank is not null")
    return chosen.select("id", F.row_number().over(W.orderBy("rank", "pos")).cast("long").alias("pos"))  # 30 rows at most


def retrieve(nodes: DataFrame, edges: DataFrame, question: str, hops: int = 2, learned: tuple[str, ...] = ()) -> DataFrame:
    """(id, hop, parent, visit): nodes within ``hops`` calls of the question's seeds, the node that found each, and the order."""
    return G.bfs(edges, seeds(nodes, question, learned), hops)


def steps(found: DataFrame, nodes: DataFrame, k: int = 20) -> DataFrame:
    """(step, id, hop, parent, edge, kind): the first ``k`` visited nodes of a subgraph, the edge to each, and its kind."""
    first = found.orderBy("visit").limit(k).join(nodes.select("id", "intent"), "id")
    edge = F.when(F.col("parent").isNull(), "ENTRY").otherwise("CALLS")
    return first.select(F.row_number().over(W.orderBy("visit")).cast("long").alias("step"), "id", "hop", "parent", edge.alias("edge"), T.step_kind(F.col("intent"), F.lit("CALLS")).alias("kind"))  # k rows


def suggestions(query_terms: DataFrame, learned: DataFrame, k: int = 10) -> DataFrame:
    """(query, names): names mapped to a query's terms, in the terms' order, distinct, ``k`` at most.

    ``query_terms``: query, pos, term. ``learned``: term, confidence, names (array); only a confidence over 0.1 counts.
    """
    hit = query_terms.join(learned.where("confidence > 0.1").select("term", "names"), "term")
    rows = hit.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("pos", "names"))).alias("s"))
    return rows.select("query", F.slice(F.array_distinct(F.flatten(F.transform("s", lambda x: x["names"]))), 1, k).alias("names"))


def explanation(found: DataFrame, question: str, k: int = 5) -> DataFrame:
    """(explanation): the first ``k`` nodes of a subgraph (id, hop, visit) as one line; a fixed text where there are none.

    Without ``visit`` they come by hop and id.
    """
    order = ["visit"] if "visit" in found.columns else ["hop"]
    first = found.orderBy(*order, "id").limit(k).agg(F.array_sort(F.collect_list(F.struct(*order, "id"))).alias("s"))
    path = F.array_join(F.transform("s", lambda x: x["id"]), " → ")
    none = F.lit("(stub) No relevant functions found in the graph.")
    return first.select(F.when(F.size("s") == 0, none).otherwise(F.concat(F.lit(f"(stub) According to the graph, the execution path for '{question}' is: "), path)).alias("explanation"))


def evidence(found: DataFrame, nodes: DataFrame, k: int = 15) -> DataFrame:
    """(pos, line): the first ``k`` visited nodes of a subgraph (id, parent, visit), how each was reached, and its summary."""
    first = found.orderBy("visit").limit(k)
    first = first.withColumn("pos", F.row_number().over(W.orderBy("visit"))).join(nodes.select("id", "summary"), "id")  # k rows
    how = F.when(F.col("parent").isNull(), " is an entry").otherwise(F.concat(F.lit(" is called by "), "parent"))
    return first.select("pos", F.concat("id", how, F.lit(": "), "summary").alias("line"))
