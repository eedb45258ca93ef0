"""Benchmark decontamination, DataFrame functions only.

Every window of ``n`` consecutive benchmark words becomes one hash in a broadcast
set. A training text's words are exploded in the scan's own stage, so all of this
is generated code: a word and the next are looked up in the set of the windows'
leading pairs, and where they are in it, the hash of the window that begins there
is looked up in the set of windows; each hit is verified word by word before it
counts. Beyond a bound of windows nothing is broadcast: hashes alone are joined
in a shuffle, spread over salts, and texts that have one are verified afterwards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, row_key, small, words

WINDOW = 10
#: Leading word pairs of windows are broadcast up to so many, a number each (32 MB).
LEADS = 1 << 21
#: Common windows of a long benchmark are spread over so many tasks.
SALTS = 16


def benchmark_windows(benchmark: DataFrame, n: int = WINDOW, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Distinct windows as (b_hash, b_len, b_words, b_items); b_items are the items, as strings, that hold the window.

    An item of fewer than ``n`` words is one window; null and wordless items have none; a null id counts as "".
    """
    items = benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("b_item"), words(F.col(text_col)).alias("b_all"))
    items = items.where(F.size("b_all") > 0).withColumn("b_len", F.least(F.lit(n), F.size("b_all")))
    at = items.select("b_item", "b_all", "b_len", F.explode(F.sequence(F.lit(1), F.size("b_all") - F.col("b_len") + 1)).alias("b_at"))
    at = at.select("b_item", "b_len", F.slice("b_all", F.col("b_at"), F.col("b_len")).alias("b_words"))
    return at.groupBy("b_len", "b_words").agg(F.collect_set("b_item").alias("b_items")).select(F.xxhash64("b_words").alias("b_hash"), "b_len", "b_words", "b_items")


def _candidates(scan: DataFrame, bench: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """(*keep, at, len, h): places of ``scan`` (k1, k2, w) where a window may begin, with the hash of the window there.

    A window of one word is led by that word alone. Where the pairs are too many to broadcast all places are candidates.
    A place may come twice.
    """
    sizes = sorted(r[0] for r in bench.select("b_len").distinct().collect())  # at most n values
    first, second = F.get("b_words", F.lit(0)), F.get("b_words", F.lit(1))
    side = small(bench.select(F.when(F.col("b_len") > 1, F.xxhash64(first, second)).otherwise(F.xxhash64(first)).alias("p")).distinct(), LEADS)
    out = scan.select("k1", "k2", "w", F.posexplode("w").alias("at", "x"))
    if side is not None:
        lead = F.xxhash64("x", F.get("w", F.col("at") + 1))
        lead = F.explode(F.array(lead, F.xxhash64("x"))) if 1 in sizes else lead
        out = out.withColumn("p", lead).join(side, "p", "left_semi")
    lengths = F.lit(sizes[0]) if len(sizes) == 1 else F.explode(F.array(*map(F.lit, sizes)).cast("array<int>"))
    out = out.withColumn("len", lengths).where(F.col("at") + F.col("len") <= F.size("w"))
    return out.select(*keep, "at", "len", F.xxhash64(F.slice("w", F.col("at") + 1, F.col("len"))).alias("h"))


def hits(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Contaminated rows only: (k1, k2, spans array<struct<at,len>>, items array<string>) by the row's key.

    ``at`` counts words from 0.  Equal rows (same id and text) share one key and one result.
    """
    bench = benchmark_windows(benchmark, n)
    k1, k2 = row_key(docs, id_col, text_col)
    scan = docs.select(k1.alias("k1"), k2.alias("k2"), words(docs[text_col]).alias("w"))
    same = (F.col("h") == F.col("b_hash")) & (F.col("len") == F.col("b_len"))
    verified = F.slice(F.col("w"), F.col("at") + 1, F.col("len")) == F.col("b_words")
    side = small(bench, weight=F.size("b_items"))  # a window that many items share counts as many rows
    if side is not None:
        found = _candidates(scan, bench, ("k1", "k2", "w")).join(side, same & verified)
    else:  # no text goes through the exchange of windows: hashes decide first, then texts that have one are joined back
        salt = F.pmod(F.xxhash64("k1", "at"), F.lit(SALTS)).cast("int")
        marked = _candidates(scan, bench, ("k1", "k2")).withColumn("salt", salt)
        listed = bench.select("b_hash", "b_len").distinct().withColumn("b_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        marked = marked.join(listed, same & (F.col("salt") == F.col("b_salt")), "left_semi").drop("salt").distinct()
        exact = scan.join(marked, ["k1", "k2"]).withColumn("g", F.slice("w", F.col("at") + 1, F.col("len"))).drop("w")
        spread = exact.withColumn("salt", salt)
        listed = bench.withColumn("b_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        found = spread.join(listed, same & (F.col("salt") == F.col("b_salt")) & (F.col("g") == F.col("b_words")))
    found = found.select("k1", "k2", F.struct("at", "len").alias("span"), "b_items")
    return found.groupBy("k1", "k2").agg(F.collect_set("span").alias("spans"), F.array_distinct(F.flatten(F.collect_set("b_items"))).alias("items"))


def _covered(spans: Column) -> Column:
    """The word positions that the spans cover, each once."""
    return F.array_distinct(F.flatten(F.transform(spans, lambda s: F.sequence(s["at"], s["at"] + s["len"] - 1))))


def contamination(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, n_words, n_hit, n_items, items_sha256, contaminated.

    Null and empty texts have no words, texts of any length are read whole, equal rows share one result each, a null id
    stays null; an empty benchmark gives no hits, an empty table no rows; other columns are ignored.
    """
    found = hits(docs, benchmark, n, id_col, text_col)
    k1, k2 = row_key(docs, id_col, text_col)
    base = docs.select(docs[id_col], k1.alias("k1"), k2.alias("k2"), F.size(words(docs[text_col])).cast("long").alias("n_words"))
    out = base.join(found, ["k1", "k2"], "left")
    items = F.coalesce(F.col("items"), F.array().cast("array<string>"))
    n_hit = F.coalesce(F.size(_covered(F.col("spans"))), F.lit(0)).cast("long")
    return out.select(
        id_col, "n_words", F.when(F.col("spans").isNull(), F.lit(0).cast("long")).otherwise(n_hit).alias("n_hit"), F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort(items), ","), 256).alias("items_sha256"), F.col("spans").isNotNull().alias("contaminated"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, mode: str = "documents", n: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without contamination, same columns: ``documents`` drops rows with a hit, ``spans`` cuts the hit words.

    A cut word goes with the separators before it; other text stays as it is.  Null texts stay null.
    """
    found = hits(docs, benchmark, n, id_col, text_col)
    a, b, spans = fresh(docs, "k1", "k2", "spans")
    k1, k2 = row_key(docs, id_col, text_col)
    keyed = docs.select("*", k1.alias(a), k2.alias(b))
    found = found.select(F.col("k1").alias(a), F.col("k2").alias(b), F.col("spans").alias(spans))
    if mode == "documents":
        return keyed.join(found.select(a, b), [a, b], "left_anti").select(*[keyed[c] for c in docs.columns])
    joined = keyed.join(found, [a, b], "left")
    pieces = F.regexp_extract_all(F.col(text_col), F.lit(r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), F.lit(0))
    tail = F.regexp_extract(F.col(text_col), r"([\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*)\z", 1)
    (held,) = fresh(joined, "pieces")
    joined = joined.withColumn(held, F.when(F.col(spans).isNotNull(), pieces))
    at = F.array_except(F.sequence(F.lit(0), F.size(held) - 1), _covered(F.col(spans)))  # rows with spans have pieces
    kept = F.transform(at, lambda i: F.get(F.col(held), i))
    cut = F.when(F.col(spans).isNull(), F.col(text_col)).otherwise(F.concat(F.array_join(kept, ""), tail))
    return joined.select(*[cut.alias(c) if c == text_col else F.col(c) for c in docs.columns])
