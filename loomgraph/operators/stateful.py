"""Order-dependent folds over keyed logs: clamped scores, request reuse, greedy limits, breaker states.

Clamped scores and reuse are folds of functions that compose, so a key's rows are folded by many tasks. Greedy limits and
breakers are dealt by key, sorted within partitions and folded as they stream by: a task holds one key's state and never its
rows; the one budget of all rows is folded range by range. ``streaming.keyed`` has the same two over a stream.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import ship
from ..storage import shared_dir, written


#: Rows of a key that one piece of a fold takes, as a power of two.
PIECE = 12
#: Rows of a single budget that a task sorts.
RANGE = 1 << 20


def clamped_fold(df: DataFrame, key: str, order: list[str], delta: Column, lo: float = 0.0, hi: float = 1.0) -> DataFrame:
    """(key, score): deltas added in order from 0, clamped to [lo, hi] after each; rows without a delta don't count.

    A step is x -> min(h, max(l, x + d)), and so is one step after another: pieces of a key's sorted rows are folded to such a
    triple, then the triples, then their triples. Rows are sorted by ranges of key and order, so that a hot key's rows are
    many tasks', and no group has more than 2**PIECE rows until the few of a key's last fold.
    """
    rows = written(df.select(key, *order, delta.cast("double").alias("d")).where("d is not null"))
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    at = rows.repartitionByRange(tasks, key, *order).sortWithinPartitions(key, *order).select(key, F.lit(lo).alias("l"), F.lit(hi).alias("h"), "d", F.monotonically_increasing_id().alias("at"))
    at = written(at)
    none = F.struct(F.lit(float("-inf")).alias("l"), F.lit(float("inf")).alias("h"), F.lit(0.0).alias("d"))

    def after(f: Column, g: Column) -> Column:
        clamp = lambda x: F.least(g["h"], F.greatest(g["l"], x + g["d"]))
        return F.struct(clamp(f["l"]).alias("l"), clamp(f["h"]).alias("h"), (f["d"] + g["d"]).alias("d"))

    for piece in ([F.shiftright("at", PIECE)], [F.shiftright("at", PIECE)], []):
        at = at.groupBy(key, *[p.alias("at") for p in piece]).agg(F.sort_array(F.collect_list(F.struct("at", "l", "h", "d"))).alias("x"))
        at = at.withColumn("f", F.aggregate("x", none, after)).select(key, *(["at"] if piece else []), "f.*")
    return at.select(key, F.least("h", F.greatest("l", "d")).alias("score"))


def _fold(df: DataFrame, key: list[str], time: str, tie: str, out: str, kind: str, start: Callable, extra: list[Column] | None = None) -> DataFrame:
    """(*key, tie, out): ``start()`` gives a key's step, which is called with time and ``extra`` of each row in order."""
    ship(df.sparkSession)
    rows = df.select(*key, tie, F.col(time).cast("timestamp").cast("double").alias("_t"), *(extra or []))
    kinds, names = dict(rows.dtypes), rows.columns[len(key) + 1 :]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, step = None, None
        for batch in batches:
            got = []
            for who, *args in zip(zip(*(batch[c] for c in key)), *(batch[c] for c in names)):
                if step is None or who != now:
                    now, step = who, start()
                got.append(step(*args))
            yield batch[[*key, tie]].assign(**{out: got})

    dealt = rows.repartition(*key).sortWithinPartitions(*key, "_t", tie)
    return dealt.mapInPandas(run, ", ".join(f"{c} {kinds[c]}" for c in [*key, tie]) + f", {out} {kind}")


def _limit(limit: int, seconds: float, kept: deque[float]) -> Callable[[float], bool]:
    def step(t: float) -> bool:
        while kept and kept[0] <= t - seconds:
            kept.popleft()
        if len(kept) >= limit:
            return False
        kept.append(t)
        return True

    return step


def greedy_limit(df: DataFrame, key: str, time: str, tie: str, limit: int, seconds: float) -> DataFrame:
    """(key, tie, allowed): at most ``limit`` allowed rows within any trailing window; rejected rows don't count."""
    return _fold(df, [key], time, tie, "allowed", "boolean", lambda: _limit(limit, seconds, deque()))


def one_limit(df: DataFrame, time: str, tie: str, limit: int, seconds: float, most: int = RANGE) -> DataFrame:
    """(tie, allowed): as ``greedy_limit`` with one key for all rows, which are sorted in ranges of about ``most`` rows.

    Ranges are folded one after another, as the order demands; what passes from one to the next is the times of the last
    ``limit`` allowed rows, so that no task sorts more than a range.
    """
    spark, at = df.sparkSession, F.col(time).cast("timestamp").cast("double").alias("_t")
    rows = written(df.select(tie, at))
    kind, n = dict(rows.dtypes)[tie], rows.count()
    if not n:
        return rows.select(tie, F.lit(False).alias("allowed"))
    ranges, done = shared_dir(spark), shared_dir(spark)
    ship(spark)
    rows.repartitionByRange(max(1, -(-n // most)), "_t", tie).withColumn("_range", F.spark_partition_id()).write.partitionBy("_range").parquet(ranges)
    placed = spark.read.schema(f"{tie} {kind}, _t double, _range int").parquet(ranges)
    kept: list[float] = []
    for (k,) in sorted(placed.select("_range").distinct().collect()):
        def run(batches: Iterator[pd.DataFrame], kept: list[float] = kept) -> Iterator[pd.DataFrame]:
            step = _limit(limit, seconds, deque(kept))
            for batch in batches:
                yield batch.assign(allowed=[step(t) for t in batch["_t"]])

        part = placed.where(F.col("_range") == k).select(tie, "_t").coalesce(1).sortWithinPartitions("_t", tie)
        part.mapInPandas(run, f"{tie} {kind}, _t double, allowed boolean").write.parquet(f"{done}/_range={k}")
        last = spark.read.schema(f"{tie} {kind}, _t double, allowed boolean").parquet(f"{done}/_range={k}").where("allowed").orderBy(F.desc("_t"), F.desc(tie)).limit(limit).collect()
        kept = [*kept, *(float("nan") if r["_t"] is None else r["_t"] for r in reversed(last))][-limit:]
    return spark.read.schema(f"{tie} {kind}, allowed boolean, _range int").parquet(done).select(tie, "allowed")


def breaker(df: DataFrame, key: str, time: str, tie: str, failed: Column, failures: int = 5, rest: float = 60.0, successes: int = 3) -> DataFrame:
    """(key, tie, state) after each call of a circuit breaker: closed, open, half_open. A success takes a failure back."""
    def start():
        state, bad, good, since = "closed", 0, 0, 0.0

        def step(t: float, fail: bool) -> str:
            nonlocal state, bad, good, since
            if state == "open" and t - since >= rest:
                state, good = "half_open", 0
            if state != "open":
                if fail:
                    bad += 1
                    if state == "half_open" or bad >= failures:
                        state, since = "open", t
                else:
                    bad, good = max(0, bad - 1), good + 1
                    if state == "half_open" and good >= successes:
                        state, bad = "closed", 0
            return state

        return step

    return _fold(df, [key], time, tie, "state", "string", start, [failed.alias("_f")])


def reuse(df: DataFrame, key: list[str], time: str, tie: str, seconds: float = 300.0) -> DataFrame:
    """(*key, tie, reused): a row within ``seconds`` of the last executed one of its key reuses its result.

    The next execution after a row, if it were executed, is the first row more than ``seconds`` later: found among the rows of
    the next stretch of so many seconds, else the first of the next stretch that has rows. So a key's rows form a forest,
    and what is executed is the path from its first row, found by doubling the pointers: rounds grow with the logarithm of
    the executions, and a key's rows are many tasks'.
    """
    step = int(seconds * 1_000_000)
    rows = df.select(*key, F.col(tie).alias("tie"), F.unix_micros(F.col(time).cast("timestamp")).alias("t"))
    rows = written(rows.withColumn("part", F.floor(F.col("t") / F.lit(step))))
    place = F.struct("t", "tie")
    stretch = rows.groupBy(*key, "part").agg(F.min(place).alias("first"))
    stretch = written(stretch.withColumn("later", F.lead("first").over(W.partitionBy(*key).orderBy("part"))))
    asked = rows.select(*key, (F.col("part") + 1).alias("part"), (F.col("t") + step).alias("t"), F.lit(0).alias("own"), F.col("tie").alias("who"), place.alias("me"))
    there = rows.select(*key, "part", "t", F.lit(1).alias("own"), F.lit(None).cast(dict(rows.dtypes)["tie"]).alias("who"), place.alias("me"))
    # downwards, a question comes before the rows of its own time: only later ones are behind it
    down = W.partitionBy(*key, "part").orderBy(F.desc("t"), "own").rowsBetween(W.unboundedPreceding, W.currentRow)
    found = asked.union(there).withColumn("near", F.min(F.when(F.col("own") == 1, F.col("me"))).over(down)).where("own = 0")
    ahead = stretch.select(*key, F.col("part").alias("p"), F.col("first").alias("f"))
    last = stretch.select(*key, (F.col("part") + 1).alias("part"), "later").join(ahead.withColumnsRenamed({"p": "part", "f": "same"}), [*key, "part"], "left")
    after = stretch.select(*key, "part", F.col("later").alias("beyond"))
    found = found.join(last, [*key, "part"]).join(after, [*key, "part"], "left")
    # without rows in the next stretch the row's own stretch knows the next one that has some
    next_ = F.coalesce("near", F.when(F.col("same").isNull(), F.col("later")).otherwise(F.col("beyond")))
    jumps = [written(found.select(*key, F.col("me").alias("a"), next_.alias("b")).where("b is not null"))]
    while not jumps[-1].isEmpty():
        one = jumps[-1]
        jumps.append(written(one.join(one.select(*key, F.col("a").alias("b"), F.col("b").alias("c")), [*key, "b"]).select(*key, "a", F.col("c").alias("b"))))
    run = rows.groupBy(*key).agg(F.min(place).alias("a"))
    for jump in reversed(jumps[:-1]):
        run = written(run.union(run.join(jump, [*key, "a"]).select(*key, F.col("b").alias("a"))).distinct())
    done = run.select(*key, F.col("a.tie").alias("tie"), F.lit(True).alias("ran"))
    no_null = reduce(Column.__and__, [F.col(c).isNotNull() for c in key])
    return rows.join(done, [*key, "tie"], "left").select(*key, F.col("tie").alias(tie), (F.col("ran").isNull() & no_null).alias("reused"))
