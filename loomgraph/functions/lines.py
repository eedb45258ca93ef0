"""Line and brace rules of source text, as Columns and windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import vocabulary as V


def brace_ends(sources: DataFrame, key: str, code: str) -> DataFrame:
    """(key, end_line): the line, from 1, on which the braces opened in a text close; 1 where they never do.

    Comments after // don't count.
    """
    lines = sources.select(key, F.posexplode(F.split(code, "\n")).alias("k", "text"))
    text = F.split("text", "//")[0]
    by = W.partitionBy(key).orderBy("k")
    step = F.regexp_count(text, F.lit(r"\{")) - F.regexp_count(text, F.lit(r"\}"))
    run = lines.select(key, "k", F.sum(step).over(by).alias("depth"), F.max(text.contains("{")).over(by).alias("opened"))
    return run.groupBy(key).agg(F.coalesce(F.min(F.when(F.col("opened") & (F.col("depth") <= 0), F.col("k") + 1)), F.lit(1)).cast("int").alias("end_line"))


def call_names(code: Column, own: Column) -> Column:
    """Names before a parenthesis in order, each once, but for keywords and the function's own."""
    found = F.array_distinct(F.regexp_extract_all(code, F.lit(r"([A-Za-z_][$A-Za-z0-9_]*)\s*\("), F.lit(1)))
    return F.filter(found, lambda x: ~x.isin(*sorted(V.KEYWORDS)) & (x != own))
