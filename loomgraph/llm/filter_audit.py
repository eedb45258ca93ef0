"""Filter interaction audit: what each filter removes in every order of the filters, and who removed it earlier.

Every document becomes a mask with a bit for each filter that it fails; equal masks of a part are one cell with counts. The
cells are unpivoted against all orders and steps into long form, where a running bit-or over the earlier steps tells what
was gone already; conditional sums give a step's counts, and totals over a filter's window of all orders its Shapley sum.

Only cells reach the orders, at most 2**filters of a part, so the long form doesn't grow with the documents.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: What separates words.
BLANK = r"[\x20\x09-\x0D]+"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: The filter of repeated texts; it needs all rows, the others a text each.
REPEATED = "E"


def failures(text: Column, words: Column) -> dict[str, Column]:
    """Whether a text (not null) with these words fails A: few words, B: words repeat, C: capitals, D: symbols."""
    n = F.size(words)
    return {
        "A": n < 200,
        "B": 100 * F.size(F.array_distinct(words)) < 50 * n,
        "C": 100 * (F.length(text) - F.length(F.translate(text, CAPITALS, ""))) > 3 * F.length(text),
        "D": text.rlike("[#$%&*|]"),
    }


def cells(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(part, mask, n, good, toxic): the documents of each part and mask, and how many of them are labelled so.

    Bit k of the mask is the k-th filter of ``ABCDE``. A row fails E if a smaller id has its text; a null text is empty, a
    null part is "", a null id is neither smaller nor larger than any, so its row never fails E. Each of several equal rows
    counts, and a document with several labels has what any of them says. Texts are read whole and compared by SHA-256, so
    none is shuffled; copies are summed by part before the rows of a text meet, so a large group of them is a few rows.
    Empty tables give no cells; other columns are ignored.
    """
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    rows = docs.select(docs[id_col].alias("id"), F.coalesce(docs[part_col].cast("string"), F.lit("")).alias("part"), text.alias("text"), F.array_remove(F.split(text, BLANK), "").alias("words"))
    fails = failures(F.col("text"), F.col("words"))
    mask = sum((F.when(fails[x], 1 << k).otherwise(0) for k, x in enumerate(fails)), F.lit(0)).cast("int")
    rows = rows.select("id", "part", F.sha2("text", 256).alias("h"), mask.alias("mask"))
    rows = rows.groupBy("id", "part", "h", "mask").agg(F.count(F.lit(1)).alias("n"))
    said = lambda c: F.max(F.when(F.col(c) == 1, 1).otherwise(0)).alias(c)
    marks = labels.select(labels[id_col].alias("id"), labels["quality"].alias("quality"), labels["toxic"].alias("toxic")).where("id is not null").groupBy("id").agg(said("quality"), said("toxic"))
    none = rows.where("id is null").withColumns({"quality": F.lit(0), "toxic": F.lit(0)})  # else they would meet in one task
    rows = rows.where("id is not null").join(marks, "id", "left").na.fill(0, ["quality", "toxic"]).unionByName(none)
    # a text's rows of one part and label: how many, the smallest id, how many have that id, how many have none
    groups = rows.groupBy("h", "part", "mask", "quality", "toxic").agg(
        F.sum("n").alias("n"), F.min("id").alias("least"), F.min_by("n", "id").alias("at_least"), F.sum(F.when(F.col("id").isNull(), F.col("n")).otherwise(0)).alias("no_id")
    )
    groups = groups.withColumn("first", F.min("least").over(W.partitionBy("h")))
    kept = F.when(F.col("least") == F.col("first"), F.col("at_least")).otherwise(0) + F.col("no_id")
    bit = 1 << len(fails)
    two = F.explode(F.array(F.struct(F.col("mask").alias("m"), kept.alias("k")), F.struct((F.col("mask") + bit).alias("m"), (F.col("n") - kept).alias("k"))))
    each = groups.select("part", "quality", "toxic", two.alias("two")).select("part", "quality", "toxic", "two.*").where("k > 0")
    return each.groupBy("part", F.col("m").alias("mask")).agg(F.sum("k").alias("n"), F.sum(F.col("k") * F.col("quality")).alias("good"), F.sum(F.col("k") * F.col("toxic")).alias("toxic"))


def audit(found: DataFrame, filters: str = "ABCDE") -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) of ``cells``.

    Every part has a row for each order and step, zeros included; no cells, no rows. ``filters`` names the bits in order.
    """
    orders = ["".join(p) for p in itertools.permutations(filters)]
    long = found.withColumn("filter_order", F.explode(F.array(*map(F.lit, orders))))
    long = long.select("*", F.posexplode(F.split("filter_order", "")).alias("at", "letter"))
    bit = F.when(F.lit(False), 0)
    for k, x in enumerate(filters):
        bit = bit.when(F.col("letter") == x, 1 << k)
    long = long.withColumn("bit", bit).withColumn("fails", F.col("mask").bitwiseAND(F.col("bit")))
    before = W.partitionBy("part", "mask", "filter_order").orderBy("at").rowsBetween(W.unboundedPreceding, -1)
    long = long.withColumn("earlier", F.coalesce(F.bit_or("fails").over(before), F.lit(0)))
    fails, gone = F.col("fails") != 0, F.col("earlier") != 0

    def total(name: str, where: Column, alias: str) -> Column:
        return F.sum(F.when(where, F.col(name)).otherwise(0)).alias(alias)

    steps = long.groupBy("part", "filter_order", (F.col("at") + 1).cast("int").alias("step"), "letter").agg(
        total("n", ~fails & ~gone, "kept"), total("n", fails & ~gone, "removed"), total("n", fails & gone, "redundant"), total("n", F.col("mask") == F.col("bit"), "unique_fails"),
        total("good", fails & ~gone, "good_lost"), total("toxic", fails & ~gone, "toxic_lost"),
    )
    return steps.withColumn("shapley", F.sum("removed").over(W.partitionBy("part", "letter"))).drop("letter")
