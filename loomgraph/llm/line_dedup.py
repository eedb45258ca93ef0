"""Line dedup over levelled sorted runs of line hashes.

Documents come in batches. A batch's lines are summed to rows (hash, documents, largest id); those that the runs have settled
(enough documents, and a larger id) are taken out by a merge anti-join with each run, and the rest becomes a run of its own.
Whenever a level has ``fanout`` runs they are compacted to one of the next level. Runs are tables in buckets of the hash, sorted
within them, all with the same buckets: anti-joins shuffle only the batch, and a compaction shuffles nothing.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import bucketed, shared_dir, written
from .common import ascii_lower, fresh, row_key, small, tasks

#: Stripped from both ends of a line.
BLANK = " \t\n\x0b\x0c\r"
LEAST_CHARS, LEAST_DOCS = 20, 3
BATCHES, FANOUT = 4, 2


class Runs:
    """Runs of (h1, h2, n, last): a line's hash, how many documents had it, and the largest of their ids."""

    def __init__(self, spark: SparkSession, fanout: int = FANOUT, least_docs: int = LEAST_DOCS) -> None:
        self.levels: list[list[DataFrame]] = []
        self.fanout, self.least_docs, self.buckets = fanout, least_docs, tasks(spark)

    def runs(self) -> list[DataFrame]:
        return [run for level in self.levels for run in level]

    def add(self, keys: DataFrame) -> DataFrame:
        """Take in a batch's rows (h1, h2, id), one for each document and line; returns the run made of them.

        A document must come in one batch. Settled lines aren't added again: their count suffices and their id is larger.
        """
        new = keys.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("last"))
        for run in self.runs():
            old = run.where(F.col("n") >= self.least_docs).select(F.col("h1").alias("r1"), F.col("h2").alias("r2"), F.col("last").alias("than")).hint("merge")
            new = new.join(old, (F.col("h1") == F.col("r1")) & (F.col("h2") == F.col("r2")) & (F.col("last") <= F.col("than")), "left_anti")
        new = bucketed(new, "h1", "h2", buckets=self.buckets)
        self._put(0, new)
        return new

    def _put(self, level: int, run: DataFrame) -> None:
        if len(self.levels) == level:
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) == self.fanout:
            merged = bucketed(self._merged(self.levels[level]), "h1", "h2", buckets=self.buckets)
            self.levels[level] = []
            self._put(level + 1, merged)

    @staticmethod
    def _merged(runs: list[DataFrame]) -> DataFrame:
        # The filter drops nothing: a union of bare scans of column batches doesn't keep buckets together, one of rows does.
        return reduce(DataFrame.union, [run.where("n > 0") for run in runs]).groupBy("h1", "h2").agg(F.sum("n").alias("n"), F.max("last").alias("last"))

    def repeated(self) -> DataFrame:
        """(h1, h2, last) of lines in at least ``least_docs`` documents, over all runs."""
        return self._merged(self.runs()).where(F.col("n") >= self.least_docs).select("h1", "h2", "last")


def _hashed(text: Column, least_chars: int) -> Column:
    """An array of (h1, h2, at, first) of a text's long lines: two hashes of the key, its place, and whether it is the key's first."""
    keys = F.transform(F.split(ascii_lower(text), "\n"), lambda x: F.btrim(x, F.lit(BLANK)))
    each = F.transform(keys, lambda x, k: F.struct(F.length(x).alias("n"), F.xxhash64(x).alias("h1"), F.xxhash64(F.lit("line"), x).alias("h2"), k.alias("at")))
    long = F.transform(F.filter(each, lambda x: x["n"] >= least_chars), lambda x: F.struct(x["h1"].alias("h1"), x["h2"].alias("h2"), x["at"].alias("at")))

    def mark(rows: Column) -> Column:
        again = lambda x, k: F.get(rows, k - 1)["h1"].eqNullSafe(x["h1"]) & F.get(rows, k - 1)["h2"].eqNullSafe(x["h2"])
        return F.transform(rows, lambda x, k: F.struct(x["h1"].alias("h1"), x["h2"].alias("h2"), x["at"].alias("at"), (~again(x, k)).alias("first")))

    return F.transform(F.array(F.array_sort(long)), mark)[0]


def lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = LEAST_CHARS, batches: int = BATCHES) -> DataFrame:
    """(batch, k1, k2, id, h1, h2, at, first) of each row's long lines, written by batch; ``first`` marks one of a row's equal ones.

    Batches are ranges of numeric ids, the largest first, so that what is settled stays so; other ids are dealt by hash.
    """
    key = docs[id_col]
    if dict(docs.dtypes)[id_col] in ("tinyint", "smallint", "int", "bigint", "float", "double"):
        ends = docs.agg(F.min(key).cast("double"), F.max(key).cast("double")).first()
        lo, hi = ends[0] or 0.0, ends[1] or 0.0
        batch = F.least(F.floor((F.lit(hi) - key.cast("double")) * (batches / (hi - lo + 1))), F.lit(batches - 1))
    else:
        batch = F.pmod(F.xxhash64(key), F.lit(batches))
    k1, k2 = row_key(docs, id_col, text_col)
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    rows = docs.select(F.coalesce(batch, F.lit(batches - 1)).cast("int").alias("batch"), k1.alias("k1"), k2.alias("k2"), key.alias("id"), F.explode(_hashed(text, least_chars)).alias("x"))
    found = rows.select("batch", "k1", "k2", "id", "x.*")
    path = shared_dir(docs.sparkSession)
    found.write.partitionBy("batch").option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.schema(found.schema).parquet(path)


def deduplicate(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS, batches: int = BATCHES, fanout: int = FANOUT
) -> DataFrame:
    """``docs`` with each text less its repeated lines, plus n_lines (before) and n_dropped, renamed where ``docs`` has them.

    A line's key is the line stripped of blanks at both ends, A-Z lower-cased. Keys of at least ``least_chars`` code points in
    at least ``least_docs`` rows lose all their lines but those of the largest id that has them. A null text is one empty line
    and becomes "". Each of several rows of an id is a document; those of the largest id keep their lines. A null id is
    smaller than all others. Texts of any length are read whole; an empty table stays empty; other columns stay.
    """
    found = lines(docs, id_col, text_col, least_chars, batches)
    runs = Runs(docs.sparkSession, fanout, least_docs)
    for k in range(batches):
        runs.add(found.where((F.col("batch") == k) & F.col("first")))
    gone = runs.repeated()
    gone = small(gone) or gone  # else a sort-merge join, whose hot lines are split as skewed
    hits = found.join(gone, ["h1", "h2"]).where(~F.col("id").eqNullSafe(F.col("last")))
    # equal rows have equal places, so that a set is no longer than its text has lines
    hits = written(hits.groupBy("k1", "k2").agg(F.collect_set("at").alias("at")))
    k1, k2, at, parts, n_lines, n_dropped = fresh(docs, "k1", "k2", "at", "parts", "n_lines", "n_dropped")
    hits = hits.toDF(k1, k2, at)
    key = row_key(docs, id_col, text_col)
    out = docs.withColumns({k1: key[0], k2: key[1]}).join(hits.hint("merge"), [k1, k2], "left")  # a row for most documents
    out = out.withColumn(parts, F.split(F.coalesce(F.col(text_col).cast("string"), F.lit("")), "\n"))
    stay = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), at)
    text = F.when(F.col(at).isNull(), F.coalesce(F.col(text_col).cast("string"), F.lit(""))).otherwise(F.array_join(F.transform(stay, lambda k: F.col(parts)[k]), "\n"))
    names = [text.alias(c) if c == text_col else F.col(c) for c in docs.columns]
    return out.select(*names, F.size(parts).cast("long").alias(n_lines), F.coalesce(F.size(at), F.lit(0)).cast("long").alias(n_dropped))
