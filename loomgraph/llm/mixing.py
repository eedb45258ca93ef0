"""Mixing sources to target weights by Poisson replication, DataFrame functions only.

Each source gets a mean repetition rate = weight * target size / its own size.
A document's uniform number is a hash of (seed, id); inverting the Poisson
distribution function of its source's rate at that number gives its copies.
Copies are dealt to partitions and ordered by a hash of (seed, id, copy), which
is a global shuffle that any retry repeats exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import written
from .common import fresh, small, tasks

SEED = "mix-1"
SALTS = 32
#: Copies that are made of one row at once.
SPAN = 1 << 15


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) from the first 52 bits of an MD5 of the parts; nulls count as ""."""
    text = F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long") / F.lit(float(2**52))


def poisson_blocks(rate: Column) -> Column:
    """What ``poisson`` needs of a rate: first count, counts a block, and of each block its distance and its first weight.

    Only counts within 12 deviations (and 30) of the mean are looked at; what is left out is below a double's step. Weights
    follow from each other, w(k) = w(k - 1) * rate / k, from any first weight, and are divided by their sum, so that no
    logarithm of a factorial is needed at any rate. A block spans the square root of all counts: time and size grow with
    the fourth root of the rate for a document, and building them with the square root, once for a source.
    """
    reach = 12 * F.sqrt(rate) + 30
    first = F.greatest(F.lit(0).cast("long"), F.floor(rate - reach))
    size = F.ceil(F.sqrt(F.ceil(rate + reach) - first + 1))
    start = F.struct(F.lit(0.0).alias("c"), F.lit(1.0).alias("w"))

    def build(block: Column) -> Column:
        first, size, rate = block["first"], block["size"], block["rate"]

        def walk(acc: Column, j: Column) -> Column:
            inner = F.aggregate(
                F.sequence(F.lit(1).cast("long"), size), F.struct(acc["c"].alias("c"), acc["w"].alias("w")),
                lambda a, i: F.struct((a["c"] + a["w"]).alias("c"), (a["w"] * rate / (first + j * size + i)).alias("w")),
            )
            return F.struct(inner["c"].alias("c"), inner["w"].alias("w"), F.concat(acc["all"], F.array(F.struct(acc["c"].alias("c"), acc["w"].alias("w")))).alias("all"))

        none = F.array().cast("array<struct<c:double,w:double>>")
        all_ = F.aggregate(F.sequence(F.lit(0).cast("long"), size - 1), F.struct(start["c"].alias("c"), start["w"].alias("w"), none.alias("all")), walk)
        scaled = F.transform(F.array(all_), lambda x: F.transform(x["all"], lambda b: F.struct((b["c"] / x["c"]).alias("c"), (b["w"] / x["c"]).alias("w"))))
        return F.struct(rate.alias("rate"), first.alias("first"), size.alias("size"), scaled[0].alias("blocks"))

    return F.transform(F.array(F.struct(rate.alias("rate"), first.alias("first"), size.alias("size"))), build)[0]


def poisson(u: Column, of: Column) -> Column:
    """The Poisson count whose distribution function first exceeds ``u``; ``of`` is ``poisson_blocks`` of the rate."""
    k = F.size(F.filter(of["blocks"], lambda b: b["c"] <= u)).cast("long") - 1
    begin = F.struct(of["blocks"][k.cast("int")].alias("b"), (of["first"] + k * of["size"]).alias("k"))

    def count(x: Column) -> Column:
        step = lambda a, i: F.struct(
            (a["c"] + a["w"]).alias("c"), (a["w"] * of["rate"] / (x["k"] + i)).alias("w"), (a["n"] + F.when(a["c"] + a["w"] <= u, 1).otherwise(0)).alias("n")
        )
        begin = F.struct(x["b"]["c"].alias("c"), x["b"]["w"].alias("w"), x["k"].alias("n"))
        return F.aggregate(F.sequence(F.lit(1).cast("long"), of["size"]), begin, step, lambda a: a["n"])

    return F.when(of["rate"] > 0, F.transform(F.array(begin), count)[0]).otherwise(F.lit(0).cast("long"))


def rates(docs: DataFrame, weights: dict[str, float] | None = None, target: float | None = None, source_col: str = "source", text_col: str = "text") -> DataFrame:
    """(mix_source, mix_rate, mix_table) of every source, over all rows; the table is ``poisson_blocks``.

    A source's size is its characters, one at least for each document; the target size is the whole corpus unless given.
    Without ``weights`` all sources weigh the same; with them a source that isn't named gets rate 0. Null is a source.
    """
    sizes = docs.groupBy(F.col(source_col).alias("mix_source")).agg(F.sum(F.greatest(F.coalesce(F.length(text_col), F.lit(0)), F.lit(1))).alias("size"))
    total = sizes.agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size")).first()
    goal = float(target if target is not None else total["size"] or 0)
    if weights is None:
        share = F.lit(1.0) / max(total["n"], 1)
    else:
        of = sum(weights.values())
        share = F.lit(0.0)
        for name, weight in weights.items():
            share = F.when(F.col("mix_source").eqNullSafe(F.lit(name)), F.lit(weight / of)).otherwise(share)
    rate = share * F.lit(goal) / F.col("size")
    return sizes.select("mix_source", rate.alias("mix_rate")).withColumn("mix_table", poisson_blocks(F.col("mix_rate")))


def mix(docs: DataFrame, weights: dict[str, float] | None = None, target: float | None = None, seed: str = SEED, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """``docs`` with each row repeated by its Poisson count, in global random order, plus copy, n_copies and mix_key.

    Rows with equal ids get equal counts; a null id is hashed as "", a null source is a source, a null text counts as one
    character; texts of any length are carried whole; an empty table stays empty. Where ``docs`` has a column named copy,
    n_copies or mix_key, the new one's name has leading underscores. Counts may be of any size: they are exploded in three
    levels of at most ``SPAN``, and where a rate is over it, a document's spans are dealt to all tasks before their copies are made.
    """
    copy, n, key, src, cdf, salt, a, b = fresh(docs, "copy", "n_copies", "mix_key", "mix_source", "mix_table", "mix_salt", "mix_a", "mix_b")
    table = written(rates(docs, weights, target, source_col, text_col))
    most = table.agg(F.max("mix_rate")).first()[0] or 0
    table = table.select(F.col("mix_source").alias(src), F.col("mix_table").alias(cdf))
    side, left, on = small(table, weight=F.size(F.col(cdf)["blocks"])), docs, docs[source_col].eqNullSafe(F.col(src))
    if side is None:  # many sources: a shuffled join whose hot sources are spread over salts
        left = docs.withColumn(salt, F.pmod(F.xxhash64(F.col(id_col)), F.lit(SALTS)).cast("int"))
        side = table.withColumn("_" + salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        on = left[source_col].eqNullSafe(F.col(src)) & (F.col(salt) == F.col("_" + salt))
    joined = left.join(side, on).select(*[left[c] for c in docs.columns], uniform(F.lit(seed), left[id_col]).alias(key), cdf)
    spans = joined.withColumn(n, poisson(F.col(key), F.col(cdf))).where(F.col(n) > 0).select(*docs.columns, n)
    if most <= SPAN / 2:  # no count of a chance above 1e-300 is over SPAN
        copies = spans.select(*docs.columns, n, F.explode(F.sequence(F.lit(1).cast("long"), F.col(n))).alias(copy))
    else:
        of = lambda k: F.sequence(F.lit(0).cast("long"), F.least(F.lit(SPAN - 1), k))
        div = lambda x, k: F.call_function("div", x, F.lit(k))
        spans = spans.withColumn(a, F.explode(F.sequence(F.lit(0).cast("long"), div(F.col(n) - 1, SPAN * SPAN))))
        spans = spans.withColumn(b, F.explode(of(div(F.col(n) - 1 - F.col(a) * SPAN * SPAN, SPAN))))
        spans = spans.withColumn(a, (F.col(a) * SPAN + F.col(b)) * SPAN)
        spans = spans.repartition(tasks(docs.sparkSession), F.col(id_col), F.col(a))
        copies = spans.withColumn(copy, F.explode(of(F.col(n) - 1 - F.col(a)))).select(*docs.columns, n, (F.col(a) + F.col(copy) + 1).alias(copy))
    copies = copies.withColumn(key, F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.col(copy).cast("string"))))
    return copies.repartition(tasks(docs.sparkSession), key).sortWithinPartitions(key)
