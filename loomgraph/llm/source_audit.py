"""Source divergence audit: how far each source's words are from those of the other sources of its language.

A smoothed share p of a term depends only on its count and its group's totals, so a sum over all kept terms of a pair of
groups needs no row for a term that neither holds. By inclusion and exclusion over the two supports it is

    V * f(zero, zero)                                          a constant for terms that both lack
    + sum over one's terms of f(count, zero) - f(zero, zero)   priced from its histogram of counts, for each side
    + sum over common terms of what the two prices got wrong   from a join of the postings by term

All arithmetic is of whole numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..storage import written
from .common import ascii_lower, small

#: What separates terms, after A-Z were lower-cased.
BETWEEN_TERMS = r"[\x00-\x60\x7B-\x7F]+"
#: Shares are counted in parts of this many.
UNIT = 1_000_000_000
SALTS = 32


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def share(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(UNIT * (count + 1) / (total + kept)); 1 where nothing is kept."""
    whole = (total + kept).cast("decimal(20,0)")
    return F.when(kept > 0, 1 + _div(F.lit(UNIT).cast("decimal(10,0)") * (count + 1).cast("decimal(20,0)"), whole)).otherwise(F.lit(1).cast("long"))


def gap(p: Column, q: Column) -> Column:
    """floor((p - q)**2 / q)."""
    return _div((p - q) * (p - q), q)


def postings(docs: DataFrame, least_docs: int = 3, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, term, source, n, total, first): each kept term's count in each source that has it and in its language.

    ``first`` marks one row of a (lang, term). A term is kept in a language where at least ``least_docs`` rows have it.
    Null texts, languages and sources are "".
    """
    clean = lambda c: F.coalesce(docs[c].cast("string"), F.lit(""))
    rows = docs.select(clean(lang_col).alias("lang"), clean(source_col).alias("source"), F.array_remove(F.split(ascii_lower(clean(text_col)), BETWEEN_TERMS), "").alias("terms"))
    # a scan gives both kinds of rows: one of every term, for counts, and one of each different term, for documents
    both = F.explode(F.array(F.struct(F.col("terms"), F.lit(1).alias("n"), F.lit(0).alias("d")), F.struct(F.array_distinct("terms").alias("terms"), F.lit(0).alias("n"), F.lit(1).alias("d"))))
    each = rows.select("lang", "source", both.alias("b")).select("lang", "source", "b.n", "b.d", F.explode("b.terms").alias("term"))
    counts = each.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))
    by = W.partitionBy("lang", "term")
    found = counts.select("lang", "term", "source", "n", F.sum("d").over(by).alias("docs"), F.sum("n").over(by).alias("total"), (F.min("source").over(by) == F.col("source")).alias("first"))
    return found.where(F.col("docs") >= least_docs).drop("docs")


def totals(docs: DataFrame, posts: DataFrame, lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, size, kept, whole): of every group its terms' occurrences, its language's kept terms and theirs."""
    clean = lambda c: F.coalesce(docs[c].cast("string"), F.lit(""))
    groups = docs.select(clean(lang_col).alias("lang"), clean(source_col).alias("source")).distinct()
    sizes = posts.groupBy("lang", "source").agg(F.sum("n").alias("size"), F.sum(F.col("first").cast("long")).alias("kept"))
    sizes = groups.join(sizes, ["lang", "source"], "left").na.fill(0, ["size", "kept"])
    langs = sizes.groupBy("lang").agg(F.sum("kept").alias("kept"), F.sum("size").alias("whole"))
    return sizes.drop("kept").join(langs, "lang")


def _beside(left: DataFrame, groups: DataFrame) -> DataFrame:
    """``left`` (lang, source, ...) with every other source of its language as (item, zero_i)."""
    other = groups.select("lang", F.col("source").alias("item"), F.col("zero").alias("zero_i"))
    side = small(other)
    if side is not None:
        return left.join(side, "lang").where("source <> item")
    left = left.withColumn("_salt", F.pmod(F.xxhash64(*left.columns), F.lit(SALTS)).cast("int"))
    side = other.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return left.join(side, ["lang", "_salt"]).drop("_salt").where("source <> item")


def pairs(posts: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value) of every two sources of a language; ``posts`` with p and zero, ``groups`` with zero."""
    wide = lambda c: c.cast("decimal(38,0)")
    p, q, zero, zero_i = F.col("p"), F.col("q"), F.col("zero"), F.col("zero_i")
    none = _beside(groups.select("lang", "source", "zero", "kept"), groups)
    parts = none.select("lang", "source", "item", (wide(gap(zero, zero_i)) * wide(F.col("kept"))).alias("v"))
    hist = posts.groupBy("lang", "source", "zero", "p").agg(F.count(F.lit(1)).alias("k"))  # equal counts of a group have equal p
    one = _beside(hist, groups)
    k = wide(F.col("k"))
    for a, b, v in (("source", "item", gap(p, zero_i) - gap(zero, zero_i)), ("item", "source", gap(zero_i, p) - gap(zero_i, zero))):
        parts = parts.union(one.select("lang", F.col(a), F.col(b), k * wide(v)))
    other = posts.select("lang", "term", F.col("source").alias("item"), F.col("p").alias("q"), F.col("zero").alias("zero_i"))
    common = posts.select("lang", "term", "source", "p", "zero").join(other.hint("merge"), ["lang", "term"]).where("source < item")
    wrong = lambda p, q, p0, q0: F.sum(wide(gap(p, q) - gap(p, q0) - gap(p0, q) + gap(p0, q0)))
    common = common.groupBy("lang", "source", "item").agg(wrong(p, q, zero, zero_i).alias("there"), wrong(q, p, zero_i, zero).alias("back"))
    parts = parts.union(common.select("lang", "source", "item", "there")).union(common.select("lang", F.col("item"), F.col("source"), "back"))
    return parts.groupBy("lang", "source", "item").agg(F.sum("v").cast("long").alias("value"))


def divergence(docs: DataFrame, ranks: int = 200, least_docs: int = 3, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, part, item, value, rank): the pairs of sources, and the terms that a source has more of.

    Part ``pair``: each other source of the language, all ranks. Part ``term``: the kept terms whose share in the group is
    above that in its language, the first ``ranks``. Ranks are by value descending, then item.

    Null texts, languages and sources are ""; each of several equal rows is a document. A language in which no term is kept
    has pairs of value 0 and no terms. Texts are read whole; empty tables give no rows; other columns are ignored. Counts
    are summed before they are shuffled, so a frequent term is a row of each task; only pairs of sources grow with the
    square of anything, as the result does.
    """
    posts = written(postings(docs, least_docs, text_col, lang_col, source_col))
    zero = share(F.lit(0), F.col("size"), F.col("kept"))
    groups = written(totals(docs, posts, lang_col, source_col).withColumn("zero", zero))
    side = small(groups)
    if side is None:  # many groups: a large one's postings are spread
        salted = posts.withColumn("_salt", F.pmod(F.xxhash64("term"), F.lit(SALTS)).cast("int"))
        posts = salted.join(groups.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["lang", "source", "_salt"]).drop("_salt")
    else:
        posts = posts.join(side, ["lang", "source"])
    priced = posts.select("lang", "source", "term", "zero", share(F.col("n"), F.col("size"), F.col("kept")).alias("p"), share(F.col("total"), F.col("whole"), F.col("kept")).alias("q"))
    by = W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    two = pairs(priced, groups).select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(by).alias("rank"))
    more = priced.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), gap(F.col("p"), F.col("q")).alias("value"))
    return two.union(more.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= ranks))
