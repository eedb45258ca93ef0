"""URL filters: host-suffix / path-prefix expressions, matched by short hash prefix, confirmed by full digest.

Every rule is one expression host + path.  A URL expands into its host suffixes
of as many labels as rules have times its path prefixes of the lengths that rules have; both sides are joined on
the first 32 bits of SHA-256 and the whole digest then decides.  The longest
rule wins; on equal length, block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, row_key, small

#: The rules of the registered query as (verdict, host, path).
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
DEFAULT = "allow"
SALTS = 32


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    return spark.createDataFrame(rules, "verdict string, host string, path string")


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty for null or without "://"."""
    rest = F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://(.*)\z", 1), F.lit(""))
    host = F.regexp_extract(rest, r"\A([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1)
    return ascii_lower(host), path


def _suffixes(host: Column, sizes: list[int]) -> Column:
    """The host's last labels, as many as rules have: of a host of many labels no more than that."""
    labels = F.split(host, r"\.", -1)
    fits = F.filter(F.array(*[F.lit(n) for n in sizes or [1]]), lambda n: n <= F.size(labels))
    return F.transform(fits, lambda n: F.array_join(F.slice(labels, F.size(labels) - n + 1, n), "."))


def judge(pages: DataFrame, rules: DataFrame, default: str = DEFAULT, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per page: id, host, path, rule (host + path, or null), verdict.

    Null urls have empty host and path and get the default verdict unless a rule has an empty host; repeated rows each
    get a row; a url of any length is read whole, only as many of its labels and characters as a rule has are expanded; an
    empty table gives no rows, an empty rule table the default; rules with a null part are ignored; other columns don't matter.
    """
    rules = rules.dropna().select("verdict", F.concat("host", "path").alias("rule"), F.length("path").alias("plen"), F.size(F.split("host", r"\.", -1)).alias("labels")).distinct()
    lengths = [r[0] for r in rules.select("plen").distinct().collect()]  # bounded by the longest rule
    sizes = [r[0] for r in rules.select("labels").distinct().collect()]  # and by the rule of most labels
    host, path = split_url(pages[url_col])
    k1, k2 = row_key(pages, id_col, url_col)
    base = pages.select(pages[id_col], host.alias("host"), path.alias("path"), k1.alias("k1"), k2.alias("k2"))
    fits = F.filter(F.array(*[F.lit(x) for x in lengths] or [F.lit(0)]), lambda x: x <= F.length("path"))
    cells = base.select("k1", "k2", "path", F.explode(_suffixes(F.col("host"), sizes)).alias("suffix"), fits.alias("fits"))
    cells = cells.select("k1", "k2", "suffix", F.explode("fits").alias("plen"), "path")
    cells = cells.select("k1", "k2", F.sha2(F.concat("suffix", F.substring("path", F.lit(1), F.col("plen"))), 256).alias("digest")).withColumn("short", F.substring("digest", 1, 8))
    listed = rules.select("verdict", "rule", F.sha2("rule", 256).alias("r_digest")).withColumn("r_short", F.substring("r_digest", 1, 8))
    side = small(listed)
    on = (F.col("short") == F.col("r_short")) & (F.col("digest") == F.col("r_digest"))
    if side is None:  # a long list: a shuffled join; a rule that fits very many pages is spread over salts
        side = listed.withColumn("r_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        cells = cells.withColumn("salt", F.pmod("k1", F.lit(SALTS)).cast("int"))
        on = on & (F.col("salt") == F.col("r_salt"))
    won = cells.join(side, on).groupBy("k1", "k2").agg(F.max(F.struct(F.length("rule").alias("n"), (F.col("verdict") == "block").alias("b"), "rule", "verdict")).alias("won"))
    out = base.join(won, ["k1", "k2"], "left")
    return out.select(id_col, "host", "path", F.col("won.rule").alias("rule"), F.coalesce("won.verdict", F.lit(default)).alias("verdict"))
