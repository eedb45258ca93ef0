"""Indexes that are written once and read by bucket: trigrams of names, and words of nodes with what they can add to a score.

Both number the nodes densely, keep a posting list in blocks of ``BLOCK`` numbers as differences of sorted numbers, and are
partitioned by a hash of the trigram or word, so that a lookup reads the folders of what it asks for and nothing else.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..storage import shared_dir, written
from . import retrieval as R
from .traverse import near, numbered

BUCKETS, BLOCK = 64, 1 << 11
#: Marks around a name, so that trigrams also tell where it begins and ends.
HEAD, TAIL = "\x02\x02", "\x03"
#: Lists that a lookup intersects at most: the shortest ones.
RAREST = 3
#: More than the bits of all fields.
MASK = 1 << len(R.FIELDS)


def _bucket(c) -> Column:
    return F.pmod(F.xxhash64(c), F.lit(BUCKETS)).cast("int")


def _stored(df: DataFrame) -> DataFrame:
    """``df``, dealt by bucket, written in a folder for each."""
    path = shared_dir(df.sparkSession)
    df.write.partitionBy("bucket").option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def gaps(sorted_: Column) -> Column:
    """The first of sorted numbers, then the differences."""
    return F.transform(F.array(sorted_), lambda a: F.transform(a, lambda x, k: (x - F.coalesce(F.get(a, k - 1), F.lit(0))).cast("int")))[0]


def _summed(gap: Column, extra: list[Column]) -> Column:
    """Rows of a posting list: the running sums of its gaps, beside the elements of ``extra``."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("all"))
    sums = F.aggregate(gap, start, lambda a, g: F.struct((a["at"] + g).alias("at"), F.concat(a["all"], F.array((a["at"] + g).cast("int"))).alias("all")), lambda a: a["all"])
    return F.arrays_zip(sums.alias("at"), *extra)


def trigrams(text: Column) -> Column:
    """The different runs of three characters of a text; none of a shorter one."""
    return F.when(F.length(text) >= 3, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text) - 2), lambda i: F.substring(text, i, 3)))).otherwise(F.array().cast("array<string>"))


def grams_of(text: str) -> list[str]:
    return sorted({text[k : k + 3] for k in range(len(text) - 2)})


@dataclass
class NameIndex:
    """nodes: (num, id, name, low); postings: (gram, block, n, gaps, bucket) over the lower-cased names between marks."""

    nodes: DataFrame
    postings: DataFrame

    @classmethod
    def build(cls, nodes: DataFrame) -> NameIndex:
        """Of nodes (id, name); null names have no trigram and are never found."""
        at = written(numbered(nodes.select("id", "name"), "num", "id", "name").withColumn("low", F.lower("name")))
        each = at.where("low is not null").select("num", F.explode(trigrams(F.concat(F.lit(HEAD), "low", F.lit(TAIL)))).alias("gram"))
        # differences begin anew in each block, so a list has no more than BLOCK numbers however common its trigram is
        each = each.groupBy("gram", F.call_function("div", F.col("num"), F.lit(BLOCK)).alias("block")).agg(F.sort_array(F.collect_list((F.col("num") % BLOCK).cast("int"))).alias("at"))
        return cls(at, _stored(each.select("gram", "block", F.size("at").alias("n"), gaps(F.col("at")).alias("gaps"), _bucket("gram").alias("bucket")).repartition("bucket")))

    def asked(self, grams: list[str]) -> DataFrame:
        """The postings of some trigrams; reads their buckets only."""
        spark = self.nodes.sparkSession
        buckets = spark.range(1).select(F.explode(F.array(*map(F.lit, grams))).alias("g")).select(_bucket("g")).distinct().collect()
        return self.postings.where(F.col("bucket").isin([r[0] for r in buckets]) & F.col("gram").isin(grams))

    def candidates(self, grams: list[str]) -> DataFrame:
        """(num) of the nodes that have all of the rarest of these trigrams."""
        found = self.asked(grams)
        sizes = {r["gram"]: r["n"] for r in found.groupBy("gram").agg(F.sum("n").alias("n")).collect()}
        if len(sizes) < len(grams):
            return self.nodes.select("num").limit(0)
        rare = sorted(sizes, key=lambda g: (sizes[g], g))[:RAREST]
        rows = self.asked(rare).select("block", F.explode(_summed(F.col("gaps"), [])).alias("x")).select((F.col("block") * BLOCK + F.col("x.at")).alias("num"))
        return rows.groupBy("num").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == len(rare)).select("num")

    def containing(self, part: str) -> DataFrame:
        """(num, id, name, low) of names that hold ``part`` in any case; a part of less than three characters scans the names."""
        low = part.lower()
        found = self.nodes.where(F.col("low").contains(low))
        return found if len(low) < 3 else found.join(self.candidates(grams_of(low)), "num", "left_semi")

    def find(self, key: str, part: str | None = None, k: int = 10) -> DataFrame:
        """(name, id, pos) of names that hold ``part`` (or the key): the key itself, then as a prefix, then the rest, by id."""
        low = key.lower()
        tier = F.when(F.col("low") == low, 0).when(F.col("low").startswith(low), 1).otherwise(2)
        first = self.containing(key if part is None else part).select("name", "id", tier.alias("_t")).orderBy("_t", "id").limit(k)
        return first.select("name", "id", F.row_number().over(W.orderBy("_t", "id")).cast("long").alias("pos"))  # k rows

    def by_prefix(self, asked: DataFrame) -> DataFrame:
        """(q, id) of the smallest id whose name begins with each asked text (q), in any case.

        Of a text's trigrams, the mark before its beginning among them, the rarest is looked up; hits are verified.
        """
        each = asked.where("q <> ''").select("q", F.lower("q").alias("k")).distinct()
        grams = each.select("q", "k", F.explode(trigrams(F.concat(F.lit(HEAD), "k"))).alias("gram"))
        sizes = self.postings.groupBy("gram").agg(F.sum("n").alias("n"))
        rare = grams.join(sizes, "gram", "left").groupBy("q", "k").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("r")).where("r.n > 0")
        hits = rare.select("q", "k", F.col("r.gram").alias("gram")).join(self.postings, "gram").select("q", "k", "block", F.explode(_summed(F.col("gaps"), [])).alias("x"))
        hits = hits.select("q", "k", (F.col("block") * BLOCK + F.col("x.at")).alias("num"))
        return hits.join(self.nodes, "num").where(F.col("low").startswith(F.col("k"))).groupBy("q").agg(F.min("id").alias("id"))


@dataclass
class WordIndex:
    """nodes: (num, *columns); postings: (word, block, n, documents, most, gaps, impacts, bucket).

    ``impacts`` are a node's field weights for a word, ``most`` the largest in the block, ``documents`` how many of its nodes
    have the word in a field that counts for IDF. Blocks are the same ranges of numbers for all words, so the most that a block
    can give a question is the sum over its words, known before any list is read.
    """

    nodes: DataFrame
    postings: DataFrame
    size: int
    block: int

    @classmethod
    def build(cls, nodes: DataFrame, block: int = BLOCK) -> WordIndex:
        at = numbered(nodes, "num", "id")
        # a node's words with a bit for each field that has them, merged in its row; a list's numbers hold place and bits
        entries = lambda c, k: F.map_from_entries(F.transform(F.array_distinct(T.tokens(F.col(c))), lambda t: F.struct(t, F.lit(1 << k))))
        words = reduce(lambda a, b: F.map_zip_with(a, b, lambda _, x, y: F.coalesce(x, F.lit(0)).bitwiseOR(F.coalesce(y, F.lit(0)))), [entries(c, k) for k, c in enumerate(R.FIELDS)])
        each = at.select("num", F.explode(words).alias("word", "bits"))
        part = F.call_function("div", F.col("num"), F.lit(block))
        rows = each.groupBy("word", part.alias("block")).agg(F.sort_array(F.collect_list((F.col("num") % block).cast("int") * MASK + F.col("bits"))).alias("x"))
        rows = rows.withColumn("bucket", _bucket("word")).repartition("bucket")
        has = lambda x, k: F.shiftright(x, k) % 2
        weight = lambda x: sum((has(x, k) * w for k, w in enumerate(R.FIELDS.values())), F.lit(0.0))
        counted = sum(1 << k for k, c in enumerate(R.FIELDS) if c != "intent")
        rows = rows.withColumns({"documents": F.size(F.filter("x", lambda x: x.bitwiseAND(counted) > 0)).cast("long"), "impacts": F.transform("x", weight)})
        rows = rows.select("word", "block", F.size("x").alias("n"), "documents", F.array_max("impacts").alias("most"), gaps(F.transform("x", lambda x: F.floor(x / MASK).cast("int"))).alias("gaps"), "impacts", "bucket")
        return cls(at, _stored(rows), at.count(), block)

    def asked(self, words: list[str]) -> DataFrame:
        spark = self.nodes.sparkSession
        buckets = spark.range(1).select(F.explode(F.array(*map(F.lit, words))).alias("g")).select(_bucket("g")).distinct().collect()
        return self.postings.where(F.col("bucket").isin([r[0] for r in buckets]) & F.col("word").isin(words))

    def _scores(self, lists: DataFrame, idf: Column) -> DataFrame:
        rows = lists.select("word", "block", F.explode(_summed(F.col("gaps"), [F.col("impacts")])).alias("x"))
        return rows.groupBy((F.col("block") * self.block + F.col("x.at")).alias("num")).agg(F.round(F.sum(F.col("x.impacts") * idf), 9).alias("score"))

    def best(self, question: str, k: int = R.SHORTLIST, first: int = 4) -> DataFrame:
        """(num, score) of the ``k`` best nodes that share a word with the question; equal scores by number downwards.

        The blocks that can give most are scored first; of the others only those are read that can still reach the k-th score.
        """
        words = R.question_words(question)
        none = self.nodes.select("num", F.lit(0.0).alias("score")).limit(0)
        if not words:
            return none
        lists = self.asked(words)
        df = lists.groupBy("word").agg(F.sum("documents").alias("df")).collect()  # at most the question's words
        if not df:
            return none
        idf = F.lit(1.0)  # a word of intents alone
        for r in df:
            if r["df"]:
                idf = F.when(F.col("word") == r["word"], F.log(F.lit((self.size + 1.0) / (r["df"] + 1))) + 1).otherwise(idf)
        bounds = written(lists.groupBy("block").agg(F.sum(F.col("most") * idf).alias("bound")))  # lists themselves aren't read here
        top = bounds.orderBy(F.desc("bound"), "block").limit(first)
        leaders = written(self._scores(lists.join(F.broadcast(top.select("block")), "block", "left_semi"), idf).orderBy(F.desc("score"), F.desc("num")).limit(k))
        found = leaders.agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least")).first()
        reach = F.col("bound") >= F.lit((found["least"] or 0.0) - 1e-6) if found["n"] == k else F.lit(True)
        rest = bounds.where(reach).join(F.broadcast(top.select("block")), "block", "left_anti")
        n = rest.count()
        if not n:
            return leaders
        more = self._scores(lists.join(near(rest.select("block"), n), "block", "left_semi"), idf)
        return leaders.union(more).orderBy(F.desc("score"), F.desc("num")).limit(k)

    def shortlist(self, question: str, k: int = R.SHORTLIST) -> DataFrame:
        """As ``retrieval.shortlist`` over the same nodes; unscored ones, by id downwards, fill what is left of ``k``."""
        best = written(self.best(question, k))
        rows = self.nodes.join(F.broadcast(best), "num")
        if best.count() < k:
            rest = self.nodes.join(F.broadcast(best), "num", "left_anti").withColumn("score", F.lit(0.0)).orderBy(F.desc("id")).limit(k)
            rows = rows.unionByName(rest).orderBy(F.desc("score"), F.desc("id")).limit(k)
        return rows.withColumn("pos", F.row_number().over(W.orderBy(F.desc("score"), F.desc("id")))).drop("num")  # k rows
