"""Token counts from an exact length histogram.

Documents are aggregated by encoded length; suffix sums over the lengths then
answer, for every context limit, how many documents reach it, how many tokens
they hold, and how many tokens remain when every document is cut at it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import ship
from .common import written
from .token_codes import encoder

#: Lengths in a bucket, and buckets in a bucket of the next level; four levels of suffix sums. A text has under 2**31
#: bytes and so ids, which leaves at most 2**7 sums for the driver.
BUCKET, LEVELS = 64, 4


def _lengths(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(enc.lengths(batch.column(0)), pa.int64())], names=["n_tokens"])

    return run


def histogram(docs: DataFrame, tokenizer: str, text_col: str = "text") -> DataFrame:
    """(n_tokens, n_docs) of all rows.

    A null or empty text has length 0, texts of any length are encoded whole, repeated rows count each, an empty table gives
    no rows, and other columns, of any name, are ignored.
    """
    ship(docs.sparkSession)
    found = docs.select(F.col(text_col)).mapInArrow(_lengths(tokenizer), "n_tokens long")
    return written(found.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n_docs")))


def suffix_sums(hist: DataFrame) -> DataFrame:
    """For each length that occurs: docs_at_least, tokens_at_least, truncated_total (every document cut there), share_up_to.

    Sums run within buckets of lengths, within buckets of those, and over the last level's few sums, so no task sorts all
    lengths. An empty histogram gives no rows.
    """
    level = hist.select(F.col("n_tokens").alias("b0"), F.col("n_docs").alias("d"), (F.col("n_tokens") * F.col("n_docs")).alias("t"))
    levels = []
    for k in range(LEVELS):
        up = F.floor(F.col(f"b{k}") / BUCKET).alias(f"b{k + 1}")
        level = level.select(f"b{k}", "d", "t", up)
        levels.append(level)
        level = level.groupBy(f"b{k + 1}").agg(F.sum("d").alias("d"), F.sum("t").alias("t"))
    top = sorted((tuple(r) for r in level.collect()), reverse=True)  # at most 2**31 / BUCKET**LEVELS rows
    docs, tokens, rest = sum(r[1] for r in top), sum(r[2] for r in top), []
    d = t = 0
    for b, n, m in top:
        rest.append((b, d, t))
        d, t = d + n, t + m
    after = hist.sparkSession.createDataFrame(rest, f"b{LEVELS} long, da long, ta long")  # sums over longer lengths
    for k in range(LEVELS - 1, -1, -1):
        longer = W.partitionBy(f"b{k + 1}").orderBy(F.desc(f"b{k}")).rowsBetween(W.unboundedPreceding, -1)
        within = levels[k].select(f"b{k}", f"b{k + 1}", "d", "t", *[F.coalesce(F.sum(c).over(longer), F.lit(0)).alias(c + "w") for c in "dt"])
        after = within.join(F.broadcast(after) if k == LEVELS - 1 else after, f"b{k + 1}").select(f"b{k}", *["d", "t"] * (k == 0), (F.col("da") + F.col("dw")).alias("da"), (F.col("ta") + F.col("tw")).alias("ta"))
    at_least, held, length = F.col("d") + F.col("da"), F.col("t") + F.col("ta"), F.col("b0")
    return after.select(
        length.alias("n_tokens"), F.col("d").alias("n_docs"), at_least.alias("docs_at_least"), held.alias("tokens_at_least"),
        (F.lit(tokens) - held + length * at_least).alias("truncated_total"), ((F.lit(docs) - F.col("da")) / F.lit(max(docs, 1))).alias("share_up_to"),
    )


def quantile(sums: DataFrame, q: float) -> int | None:
    """The smallest length that at least a share ``q`` of the documents doesn't exceed; None without documents."""
    return sums.where(F.col("share_up_to") >= q).agg(F.min("n_tokens")).first()[0]


def truncated(sums: DataFrame, limit: int) -> int:
    """Tokens that remain when every document is cut at ``limit``, whether or not a document has that length."""
    over = sums.where(F.col("n_tokens") > limit).agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum(F.col("n_docs") * F.col("n_tokens")), F.lit(0))).first()
    total = sums.agg(F.coalesce(F.sum(F.col("n_docs") * F.col("n_tokens")), F.lit(0))).first()[0]
    return total - over[1] + limit * over[0]
