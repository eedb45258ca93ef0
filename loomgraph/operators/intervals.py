"""The innermost span around each point, by dyadic blocks: equal keys in place of a range condition.

A span is at most two aligned blocks of each size; a point lies in one block of each size. Of the spans that share a block only
the narrowest can be innermost, so a block is one row before points meet it, and a point meets at most as many rows as there are
sizes, however many spans its file has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Places are below 2**LEVELS.
LEVELS = 31
OPEN = (1 << LEVELS) - 1


def blocks(start: Column, end: Column) -> Column:
    """The (level, block)s of the aligned blocks that make up [start, end]; none where it is empty."""
    one = lambda level, block: F.array(F.struct(level.cast("int").alias("level"), block.alias("block")))
    none = F.array().cast("array<struct<level:int,block:bigint>>")
    begin = F.struct(start.cast("long").alias("l"), (end.cast("long") + 1).alias("r"), none.alias("all"))

    def step(a: Column, k: Column) -> Column:
        odd_l, odd_r = (a["l"] < a["r"]) & (a["l"] % 2 == 1), (a["l"] + a["l"] % 2 < a["r"]) & (a["r"] % 2 == 1)
        more = F.concat(a["all"], F.when(odd_l, one(k, a["l"])).otherwise(none), F.when(odd_r, one(k, a["r"] - 1)).otherwise(none))
        return F.struct(F.shiftright(a["l"] + 1, 1).alias("l"), F.shiftright(a["r"], 1).alias("r"), more.alias("all"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(LEVELS)), begin, step, lambda a: a["all"])


def innermost(points: DataFrame, spans: DataFrame, key: str, at: str, start: str, end: str, value: str) -> DataFrame:
    """``points`` (key, at, ...) with ``value`` of the narrowest span around each, the least value of equals; else null.

    ``spans``: key, start, end (both included; a null end is open), value. Places are whole numbers from 0 to 2**31 - 1; a
    null place, or a span with a null start, is in nothing and around nothing.
    """
    s, e = F.col(start), F.coalesce(F.col(end).cast("long"), F.lit(OPEN))
    cover = spans.where(s.isNotNull()).select(F.col(key).alias("_key"), F.explode(blocks(s, e)).alias("_b"), (e - s).alias("w"), F.col(value).alias("v"))
    cover = cover.groupBy("_key", F.col("_b.level").alias("_level"), F.col("_b.block").alias("_block")).agg(F.min(F.struct("w", "v")).alias("_best"))
    place = F.col(at).cast("long")
    asked = points.select(F.col(key).alias("_key"), place.alias("_at")).where("_at is not null").distinct()
    each = asked.select("_key", "_at", F.explode(F.transform(F.sequence(F.lit(0), F.lit(LEVELS)), lambda k: F.struct(k.alias("level"), F.call_function("shiftright", F.col("_at"), k).alias("block")))).alias("_p"))
    each = each.select("_key", "_at", F.col("_p.level").alias("_level"), F.col("_p.block").alias("_block"))
    found = each.join(cover, ["_key", "_level", "_block"]).groupBy("_key", "_at").agg(F.min("_best").alias("_best"))
    out = points.join(found, (points[key] == found["_key"]) & (place == found["_at"]), "left")
    return out.select(*[points[c] for c in points.columns], F.col("_best.v").alias(value))
