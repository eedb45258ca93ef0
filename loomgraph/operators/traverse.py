"""Loops over an edge table that is laid out once: PageRank, traversal in visit order, closures, paths from both ends.

Edges are written in buckets of their source. A round joins what moves (ranks, a frontier) to them: broadcast while its counted
rows are within the bound, else shuffled to the buckets; the edges themselves are never shuffled again. What moves is written
each round, so plans stay short and a lost executor costs one round.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..storage import bucketed, written

#: Tables of at most so many counted rows are broadcast, or numbered in one task.
BROADCAST_ROWS = 200_000


def near(df: DataFrame, rows: int) -> DataFrame:
    """``df`` of so many counted rows, broadcast if they are within the bound."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def adjacency(edges: DataFrame, forward: bool = True) -> DataFrame:
    """Distinct (src, dst) in buckets of src; with both turned round if not ``forward``."""
    a, b = ("src", "dst") if forward else ("dst", "src")
    return bucketed(edges.select(F.col(a).alias("src"), F.col(b).alias("dst")).distinct(), "src")


def numbered(df: DataFrame, name: str, *order) -> DataFrame:
    """``df``, a scan or written, with a dense number from 0 as its column ``name``, in an order without ties.

    Ranges of the order are sorted in tasks of their own and written; rows are counted by range, the sums of the counts
    before each range go back as a small table, one row a task.
    """
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = df.repartitionByRange(tasks, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    placed = written(placed)  # its partition is in the upper bits, the place in it in the lower 33
    part, place = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    sizes = sorted(tuple(r) for r in placed.groupBy(part).agg(F.count(F.lit(1))).collect())
    starts = [0, *accumulate(n for _, n in sizes)]
    before = df.sparkSession.createDataFrame([(p, s) for (p, _), s in zip(sizes, starts)], "_part long, _start long")
    return placed.withColumn("_part", part).join(F.broadcast(before), "_part").withColumn(name, F.col("_start") + place).drop("_at", "_part", "_start")


def _in_order(df: DataFrame, rows: int, name: str, *order) -> DataFrame:
    if rows > BROADCAST_ROWS:
        return numbered(df, name, *order)
    return df.withColumn(name, F.row_number().over(W.orderBy(*order)).cast("long") - 1)


def bfs(edges: DataFrame, seeds: DataFrame, hops: int) -> DataFrame:
    """(id, hop, parent, visit) of nodes within ``hops`` of ``seeds`` (id, and pos if their order isn't that of the ids).

    As a queue would visit them: seeds in their order, then what each visited node calls, by id. ``visit`` counts from 0.
    ``parent`` is the first visited node that calls a node; a seed that an earlier seed calls has that one.
    """
    edges = adjacency(edges)
    pos = F.col("pos") if "pos" in seeds.columns else F.col("id")
    first = written(seeds.groupBy("id").agg(F.min(pos).alias("pos")))
    total = first.count()
    start = written(_in_order(first, total, "visit", "pos", "id").select("id", "visit"))
    if hops and total:
        calls = edges.join(near(start.select(F.col("id").alias("src"), F.col("visit").alias("pv")), total), "src")
        back = calls.join(near(start.select(F.col("id").alias("dst"), "visit"), total), "dst").where("pv < visit")
        back = back.groupBy(F.col("dst").alias("id")).agg(F.min_by("src", "pv").alias("parent"))
        seen = written(start.join(near(back, total), "id", "left").select("id", F.lit(0).alias("hop"), "parent", "visit"))
    else:
        seen = start.select("id", F.lit(0).alias("hop"), F.lit(None).cast("string").alias("parent"), "visit")
    frontier, size = seen, total
    for hop in range(1, hops + 1):
        if not size:
            break
        step = edges.join(near(frontier.select(F.col("id").alias("src"), F.col("visit").alias("pv")), size), "src")
        step = step.groupBy(F.col("dst").alias("id")).agg(F.min(F.struct("pv", "src")).alias("by"))
        found = written(step.join(near(seen.select("id"), total), "id", "left_anti").select("id", F.lit(hop).alias("hop"), F.col("by.src").alias("parent"), F.col("by.pv").alias("pv")))
        size = found.count()
        frontier = _in_order(found, size, "_k", "pv", "id").select("id", "hop", "parent", (F.col("_k") + total).alias("visit"))
        if hop < hops:
            frontier = written(frontier)
        seen, total = seen.unionByName(frontier), total + size
    return seen


def closure(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(id) of all that ``seeds`` reach, themselves included; each round starts from what the last one found."""
    edges = adjacency(edges)
    seen = frontier = written(seeds.select("id").distinct())
    total = size = frontier.count()
    while size:
        step = edges.join(near(frontier.withColumnRenamed("id", "src"), size), "src").select(F.col("dst").alias("id")).distinct()
        frontier = written(step.join(near(seen, total), "id", "left_anti"))
        size = frontier.count()
        seen, total = seen.union(frontier), total + size
    return seen


def _across(edges: DataFrame, level: DataFrame, size: int) -> DataFrame:
    return edges.join(near(level.select(F.col("id").alias("src")), size), "src").select(F.col("dst").alias("id")).distinct()


def shortest_path(edges: DataFrame, source: str, target: str) -> DataFrame:
    """(hops, path) of the shortest directed path, the smallest of equals; empty where there is none.

    Searches from both ends, a level at a time from the side whose last level is smaller, until the levels meet. Levels hold
    ids alone; those on a shortest path are traced back from where the searches met, and the path takes the least of them,
    a step at a time. Ids compare as they do in a path, with the ">" that follows them.
    """
    spark = edges.sparkSession
    if source == target:
        return spark.createDataFrame([(0, source)], "hops int, path string")
    tables = {True: adjacency(edges), False: adjacency(edges, forward=False)}
    ends = {True: source, False: target}
    levels = {side: [(written(spark.createDataFrame([(end,)], "id string")), 1)] for side, end in ends.items()}
    seen = {side: levels[side][0] for side in ends}
    while True:
        side = levels[True][-1][1] <= levels[False][-1][1]
        level, size = levels[side][-1]
        found = written(_across(tables[side], level, size).join(near(*seen[side]), "id", "left_anti"))
        size = found.count()
        if not size:
            return spark.createDataFrame([], "hops int, path string")
        levels[side].append((found, size))
        seen[side] = seen[side][0].union(found), seen[side][1] + size
        met = written(found.join(near(*levels[not side][-1]), "id", "left_semi"))
        if size := met.count():
            break
    on_path = {len(levels[True]) - 1: (met, size)}
    for side, way in ((True, -1), (False, 1)):  # back to the source, on to the target
        at, k = on_path[len(levels[True]) - 1], len(levels[True]) - 1
        for level in levels[side][-2::-1]:
            here = written(level[0].join(_across(tables[not side], *at), "id", "left_semi"))
            at, k = (here, here.count()), k + way
            on_path[k] = at
    path, hops = [source], max(on_path)
    for k in range(1, hops + 1):
        called = tables[True].where(F.col("src") == path[-1]).select(F.col("dst").alias("id"))  # one bucket's rows
        path.append(called.join(near(*on_path[k]), "id", "left_semi").agg(F.min_by("id", F.concat("id", F.lit(">"))).alias("id")).first()["id"])
    return spark.createDataFrame([(hops, ">".join(path))], "hops int, path string")


def pagerank(nodes: DataFrame, edges: DataFrame, rounds: int | None = None, tolerance: float = 1e-6, most: int = 100, damping: float = 0.85) -> DataFrame:
    """(id, rank) from the uniform start; dangling mass is spread evenly.

    Runs until a round changes the ranks by less than nodes * ``tolerance`` in all, ``most`` rounds at most; with
    ``rounds`` given, exactly so many. A round moves ranks along the edges in one shuffle of ranks.
    """
    n = nodes.count()
    if not n:
        return nodes.select("id", F.lit(0.0).alias("rank"))
    out = edges.groupBy("src").agg(F.count(F.lit(1)).alias("out"))
    links = bucketed(edges.select("src", "dst").join(near(out, n), "src"), "src")
    rank = written(nodes.select("id").join(near(out.withColumnRenamed("src", "id"), n), "id", "left").select("id", F.col("out").isNull().alias("dangling"), F.lit(1.0 / n).alias("rank")))
    lost = F.coalesce(F.sum(F.when(F.col("dangling"), F.col("rank"))), F.lit(0.0))
    idle = rank.agg(lost).first()[0]
    for _ in range(most if rounds is None else rounds):
        moved = links.join(near(rank.select(F.col("id").alias("src"), "rank"), n), "src").groupBy("dst").agg(F.sum(F.col("rank") / F.col("out")).alias("got"))
        new = (1 - damping) / n + damping * (F.coalesce("got", F.lit(0.0)) + F.lit(idle / n))
        rank = written(rank.join(near(moved, n), F.col("id") == F.col("dst"), "left").select("id", "dangling", F.col("rank").alias("was"), new.alias("rank")))
        idle, change = rank.agg(lost, F.sum(F.abs(F.col("rank") - F.col("was")))).first()
        if rounds is None and change < n * tolerance:
            break
    return rank.select("id", "rank")
