"""Communities by distributed local moves on modularity, then contraction (Blondel and others, 2008).

A level's graph is an undirected edge table with weights, both directions, self-loops apart. In a round each node of a
deterministic third sees its weight to each neighbouring community in one join and one aggregation, and moves to the best if
that gains. A round that didn't raise modularity is undone. When none does, communities become the next level's nodes. When
no level gains, the first graph's nodes move again, from the communities found, and so on until that gains nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import bucketed, written
from .traverse import near

#: Nodes move in so many turns; rounds without a gain before a level ends; rounds of a level, levels, and refinements, at most.
TURNS, PATIENCE, ROUNDS, LEVELS, CYCLES = 3, 3, 60, 20, 5
LEAST_GAIN = 1e-7


def modularity(pairs: DataFrame, community: DataFrame) -> float:
    """Of undirected ``pairs`` (a, b, w), each once, and ``community`` (id, c); 0 without pairs."""
    total = pairs.agg(F.sum("w")).first()[0]
    if not total:
        return 0.0
    at = pairs.join(community.toDF("a", "ca"), "a").join(community.toDF("b", "cb"), "b")
    inside = at.agg(F.coalesce(F.sum(F.when(F.col("ca") == F.col("cb"), F.col("w"))), F.lit(0.0))).first()[0]
    degree = at.select(F.col("ca").alias("c"), "w").union(at.select("cb", "w")).groupBy("c").agg(F.sum("w").alias("d"))
    return inside / total - (degree.agg(F.sum(F.col("d") * F.col("d"))).first()[0]) / (4 * total * total)


def _quality(community: DataFrame, links: DataFrame, loops: float, total: float, n: int) -> float:
    """Modularity of a level's state (id, c, k): weights inside, ``loops`` of them for certain, less the expected."""
    at = near(community.select("id", "c"), n)
    inside = links.join(at.toDF("src", "cs"), "src").join(at.toDF("dst", "ct"), "dst").where("cs = ct").agg(F.coalesce(F.sum("w"), F.lit(0.0))).first()[0]
    expected = community.groupBy("c").agg(F.sum("k").alias("d")).agg(F.sum(F.col("d") * F.col("d"))).first()[0]
    return (inside / 2 + loops) / total - expected / (4 * total * total)


def _moved(state: DataFrame, links: DataFrame, total: float, n: int, turn: int) -> DataFrame:
    """(id, c, k) after the nodes whose turn it is went where they gain most; equals go to the smallest community."""
    at = near(state.select(F.col("id").alias("dst"), F.col("c").alias("to")), n)
    size = state.groupBy(F.col("c").alias("to")).agg(F.sum("k").alias("d"))
    mine = state.where(F.pmod(F.xxhash64("id", F.lit(turn // TURNS)), F.lit(TURNS)) == turn % TURNS)
    weight = links.join(near(mine.select(F.col("id").alias("src")), n), "src", "left_semi").join(at, "dst").groupBy(F.col("src").alias("id"), "to").agg(F.sum("w").alias("w"))
    own = mine.select("id", F.col("c").alias("to"), F.lit(0.0).alias("w"))  # staying is always one of the choices
    rows = weight.union(own).groupBy("id", "to").agg(F.sum("w").alias("w"))
    rows = rows.join(near(size, n), "to").join(near(mine, n), "id")
    stay = F.col("to") == F.col("c")
    rest = F.col("d") - F.when(stay, F.col("k")).otherwise(0.0)
    gain = F.round(F.col("w") / total - F.col("k") * rest / (2 * total * total), 12)
    best = rows.groupBy("id").agg(F.min(F.struct((-gain).alias("g"), (~stay).alias("away"), F.col("to"))).alias("b")).select("id", F.col("b.to").alias("new"))
    return state.join(near(best, n), "id", "left").select("id", F.coalesce("new", "c").alias("c"), "k")


def _level(pairs: DataFrame, loops: DataFrame, start: DataFrame | None = None) -> tuple[DataFrame, bool]:
    """(id, c) of one level, and whether any node moved for good; ``pairs`` (a, b, w) once each, ``loops`` (id, w).

    Each node begins as its own community, or as in ``start`` (id, c).
    """
    both = pairs.select(F.col("a").alias("src"), F.col("b").alias("dst"), "w").union(pairs.select("b", "a", "w"))
    links = bucketed(both, "src")
    degree = links.select(F.col("src").alias("id"), F.col("w").alias("k")).union(loops.select("id", (2 * F.col("w")).alias("k")))
    degree = degree.groupBy("id").agg(F.sum("k").alias("k"))
    state = written(degree.select("id", F.col("id").alias("c"), "k") if start is None else degree.join(start, "id").select("id", "c", "k"))
    n, total = state.count(), state.agg(F.sum("k")).first()[0] / 2
    fixed = loops.agg(F.coalesce(F.sum("w"), F.lit(0.0))).first()[0]
    quality, moved, idle = _quality(state, links, fixed, total, n), False, 0
    for turn in range(ROUNDS):
        tried = written(_moved(state, links, total, n, turn))
        now = _quality(tried, links, fixed, total, n)
        if now > quality + LEAST_GAIN:
            state, quality, moved, idle = tried, now, True, 0
        else:
            idle += 1
            if idle == PATIENCE:
                break
    return state.select("id", "c"), moved


def louvain(edges: DataFrame) -> DataFrame:
    """(id, community) of the nodes of undirected edges (src, dst); a community has its smallest id for its name.

    Edges of a pair in both directions or several times count once, self-loops not at all. No node's edges, no community and
    no component meet in one task beyond what an aggregation needs; tables are broadcast within a counted bound only.
    """
    ends = edges.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).where("a <> b").distinct()
    first = written(ends.withColumn("w", F.lit(1.0)))
    at = written(first.select(F.col("a").alias("id")).union(first.select("b")).distinct().withColumn("c", F.col("id")))
    none = at.select("id", F.lit(0.0).alias("w")).limit(0)
    for cycle in range(CYCLES):
        pairs, loops, gained = first, none, False
        for k in range(LEVELS):
            if pairs.isEmpty():
                break
            level, moved = _level(pairs, loops, at if cycle and not k else None)
            gained = gained or moved
            if not moved and (k or not cycle):
                break
            level = written(level)
            at = level if not k else written(at.join(level.toDF("c", "up"), "c", "left").select("id", F.coalesce("up", "c").alias("c")))
            if not moved and not k:  # a refinement that moved nothing
                break
            pairs, loops = _contracted(pairs, loops, level)
        if not gained:
            break
    name = at.groupBy("c").agg(F.min("id").alias("community"))
    return at.join(name, "c").select("id", "community")


def _contracted(pairs: DataFrame, loops: DataFrame, level: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The graph whose nodes are a level's communities; what lies inside one is its loop."""
    ends = pairs.join(level.toDF("a", "ca"), "a").join(level.toDF("b", "cb"), "b").select(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b"), "w")
    ends = written(ends.groupBy("a", "b").agg(F.sum("w").alias("w")))
    old = loops.join(level, "id").select(F.col("c").alias("id"), "w")
    inside = written(ends.where("a = b").select(F.col("a").alias("id"), "w").union(old).groupBy("id").agg(F.sum("w").alias("w")))
    return ends.where("a <> b"), inside
