"""Strongly connected components, and the simple cycles inside them.

Components by trimming and colouring (Orzan, 2004; Slota and others, 2014): nodes that no cycle can pass are taken out again
and again; then each node takes the smallest id that reaches it, and from every node that keeps its own a search runs
backwards inside its colour. What it finds is that node's component. All colours work at once; a round is a join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..storage import written


def _trimmed(links: DataFrame) -> tuple[DataFrame, int]:
    """Edges without those that begin where nothing ends or end where nothing begins, until all others stay."""
    n = -1
    while True:
        now = links.count()
        if now in (n, 0):
            return links, now
        n = now
        links = written(links.join(links.select(F.col("dst").alias("src")), "src", "left_semi").join(links.select(F.col("src").alias("dst")), "dst", "left_semi").select("src", "dst"))


def _coloured(links: DataFrame) -> DataFrame:
    """(id, colour): the smallest id from which each node of the edges can be reached, its own among them."""
    colour = written(links.select(F.col("src").alias("id")).union(links.select("dst")).distinct().withColumn("colour", F.col("id")))
    moved = colour  # only nodes whose colour changed tell those they point to
    while True:
        told = links.join(moved.select(F.col("id").alias("src"), "colour"), "src").groupBy(F.col("dst").alias("id")).agg(F.min("colour").alias("new"))
        colour = written(colour.join(told, "id", "left").select("id", F.least("colour", "new").alias("colour"), (F.col("new") < F.col("colour")).alias("moved")))
        moved = colour.where("moved")
        if moved.isEmpty():
            return colour.select("id", "colour")


def strong_components(edges: DataFrame) -> DataFrame:
    """(id, component) of the nodes on directed cycles, self-loops aside; a component has its smallest id for its name.

    Nodes that aren't here are components of their own. Rounds grow with the longest of the shortest paths inside a colour
    and with how deep components hang behind each other, not with the number of components.
    """
    links, left = _trimmed(written(edges.select("src", "dst").where("src <> dst").distinct()))
    found = None
    while left:
        colour = _coloured(links)
        both = links.join(colour.toDF("src", "a"), "src").join(colour.toDF("dst", "b"), "dst").where("a = b")
        inside = written(both.select("src", "dst"))
        seen = front = written(colour.where("id = colour").select("id", F.col("colour").alias("component")))
        while True:
            step = inside.join(front.withColumnRenamed("id", "dst"), "dst").select(F.col("src").alias("id"), "component").distinct()
            front = written(step.join(seen, "id", "left_anti"))
            if front.isEmpty():
                break
            seen = seen.union(front)
        seen = written(seen)
        found = seen if found is None else found.union(seen)
        gone = seen.select("id")
        links, left = _trimmed(written(links.join(gone.toDF("src"), "src", "left_anti").join(gone.toDF("dst"), "dst", "left_anti").select("src", "dst")))
    if found is None:
        return edges.select(F.col("src").alias("id"), F.col("src").alias("component")).limit(0)
    many = found.groupBy("component").agg(F.count(F.lit(1)).alias("n")).where("n > 1")  # a colour's start may lie on no cycle
    return found.join(many, "component", "left_semi").select("id", "component")


def cycles(edges: DataFrame, names: DataFrame | None = None, longest: int = 8, enough: int | None = None, budget: int | None = None) -> DataFrame:
    """(length, path) of simple directed cycles up to ``longest``; each starts at its smallest node, so appears once.

    With ``names`` (id, name) cycles whose nodes share one name don't count; a node without a row counts as unnamed. With
    ``enough``, no length is begun once that many shorter cycles are found, so the first ``enough`` by length are whole.
    Paths grow only inside strong components, and only in those where two nodes differ in name: no other has a cycle that
    counts. All open paths go on to the next length; with ``budget`` only so many, the smallest, of each component.
    """
    part = written(strong_components(edges))
    links = edges.select("src", "dst").where("src <> dst").distinct()
    links = links.join(part.toDF("src", "component"), "src").join(part.toDF("dst", "c2"), "dst").where("component = c2").select("src", "dst", "component")
    if names is not None:
        name = names.groupBy("id").agg(F.min("name").alias("name"))
        links = links.join(name.toDF("src", "sn"), "src", "left").join(name.toDF("dst", "dn"), "dst", "left").select("src", "dst", "component", F.col("sn").eqNullSafe(F.col("dn")).alias("same"))
    else:
        links = links.withColumn("same", F.lit(False))
    links = written(links)
    if names is not None:  # a strong component of several names has an edge between two of them
        links = written(links.join(links.where("not same").select("component").distinct(), "component", "left_semi").select(*links.columns))
    step_of = links.select("src", "dst", F.col("same").alias("alike"))
    path = links.where("src < dst").select("component", F.col("src").alias("first"), F.col("dst").alias("last"), F.array("src", "dst").alias("nodes"), "same")
    found, n = None, 0
    for length in range(2, longest + 1):
        step = path.join(step_of, path["last"] == step_of["src"])
        closed = step.where((F.col("dst") == F.col("first")) & ~(F.col("same") & F.col("alike"))).select(F.lit(length).alias("length"), F.concat_ws(">", "nodes").alias("path"))
        if enough is not None:
            closed = written(closed)
            n += closed.count()
        found = closed if found is None else found.union(closed)
        if length == longest or enough is not None and n >= enough:
            break
        more = step.where((F.col("dst") > F.col("first")) & ~F.array_contains("nodes", F.col("dst")))
        more = more.select("component", "first", F.col("dst").alias("last"), F.concat("nodes", F.array("dst")).alias("nodes"), (F.col("same") & F.col("alike")).alias("same"))
        path = written(more)
        if budget is not None:
            path = written(_within(path, budget))
    return found


def _within(path: DataFrame, budget: int) -> DataFrame:
    """The smallest ``budget`` paths of each component that has more of them."""
    over = written(path.groupBy("component").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > budget).select("component"))
    if over.isEmpty():
        return path
    rank = F.row_number().over(W.partitionBy("component").orderBy("nodes"))
    cut = path.join(F.broadcast(over) if over.count() <= 200_000 else over, "component", "left_semi").withColumn("_r", rank).where(F.col("_r") <= budget).drop("_r")
    return path.join(over, "component", "left_anti").unionByName(cut.select(*path.columns))
