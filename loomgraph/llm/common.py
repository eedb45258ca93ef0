"""Helpers shared by the training-data operators."""

from __future__ import annotations

import string
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import shared_dir, written  # noqa: F401

#: What separates words: ASCII control, punctuation and space. A-Z are lower-cased before.
BETWEEN_WORDS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: A side of a join is broadcast only when its counted rows are at most this many.
BROADCAST_ROWS = 200_000


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; other letters stay as they are."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def words(text: Column) -> Column:
    """The words of a text, lower-cased; null and empty texts have none.

    Split at what is between them: a regular expression's class that holds all of Unicode but a few ASCII ranges is
    several times slower than that of the ranges.
    """
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), BETWEEN_WORDS), "")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names made from ``names`` that ``df`` doesn't have, in any letter case."""
    have = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in have:
            name = "_" + name
        have.add(name.lower())
        out.append(name)
    return out


def row_key(df: DataFrame, id_col: str, text_col: str) -> list[Column]:
    """Two hashes that identify a row by id and text: equal rows share them and share their results."""
    pair = [df[id_col], df[text_col]]
    return [F.xxhash64(*pair, df[text_col].isNull()), F.hash(F.lit(7), *pair)]


def small(df: DataFrame, rows: int = BROADCAST_ROWS, weight: Column | None = None) -> DataFrame | None:
    """A broadcast hint for ``df`` if its counted rows are within the bound, else None.

    Where rows hold arrays, ``weight`` is how many rows each counts as.
    """
    if weight is None:
        return F.broadcast(df) if df.limit(rows + 1).count() <= rows else None
    return F.broadcast(df) if (df.agg(F.sum(weight)).first()[0] or 0) <= rows else None


@contextmanager
def few_at_a_time(spark: SparkSession, rows: int = 1024) -> Iterator[None]:
    """Jobs that run meanwhile hand texts to Python in batches of at most ``rows``, which bounds what a task buffers."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, old)


def tasks(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
