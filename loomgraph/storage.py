"""The folder that driver and executors share, and tables written there to cut lineage."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


_ROOTS: dict[str, str] = {}
_MERGING: list[str] = []  # the threshold to go back to, once for each block inside ``merged``
_LOCK = threading.Lock()
THRESHOLD = "spark.sql.autoBroadcastJoinThreshold"
SHARE = 1_000_000  # rows of a task


def shared_dir(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir, in this application's own, which goes when the driver ends.

    Where that is unset, a local session gets a temporary folder (tests); on a cluster it is an error, since executors
    would write to folders of their own.
    """
    sc = spark.sparkContext
    if sc.applicationId not in _ROOTS:
        base = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            base = sc._jsc.sc().getCheckpointDir()
            base = base.get() if base.isDefined() else None
        if not base:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
            base = "file://" + tempfile.mkdtemp(prefix="loomgraph-")
            sc.setCheckpointDir(base)
        root = f"{base.rstrip('/')}/loom-{uuid.uuid4().hex}"
        path = sc._jvm.org.apache.hadoop.fs.Path(root)
        fs = path.getFileSystem(sc._jsc.hadoopConfiguration())
        fs.mkdirs(path)
        fs.deleteOnExit(path)
        _ROOTS[sc.applicationId] = root
    return f"{_ROOTS[sc.applicationId]}/{uuid.uuid4().hex}"


def _tasks(spark: SparkSession) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def dealt(df: DataFrame, *keys: str, rows: int = 0) -> DataFrame:
    """``df`` dealt by ``keys`` to as many tasks as a shuffle has, or more if more can run: for few bytes that much is made of.

    A small file is read by one task, and an adaptive shuffle of it by one again; with a fixed number it isn't. Of a table of
    ``rows`` a task gets about ``SHARE`` at most, so that it needs no more memory as the table grows.
    """
    return df.repartition(max(_tasks(df.sparkSession), -(-rows // SHARE)), *keys)


def spread(df: DataFrame, rows: int, *keys: str, share: int | None = None) -> DataFrame:
    """``df`` dealt by ``keys`` if its ``rows`` are over ``share`` for each usual task of a shuffle; else Spark chooses, and may broadcast."""
    share = share or SHARE
    return df.repartition(-(-rows // share), *keys) if rows > share * _tasks(df.sparkSession) else df


def written(df: DataFrame, codec: str = "zstd") -> DataFrame:
    """``df`` written once to the shared folder and read back: cuts lineage, survives lost executors."""
    path = shared_dir(df.sparkSession)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def merged(spark: SparkSession) -> Iterator[None]:
    """Joins that run inside are merged, unless a side is marked to be broadcast.

    Spark's own choice goes by compressed bytes: a few MB of ids are millions of rows, and all of them go through the driver.
    """
    with _LOCK:
        _MERGING.append(_MERGING[0] if _MERGING else spark.conf.get(THRESHOLD))
        spark.conf.set(THRESHOLD, "-1")
    try:
        yield
    finally:
        with _LOCK:
            was = _MERGING.pop()
            if not _MERGING:
                spark.conf.set(THRESHOLD, was)


def bucketed(df: DataFrame, *keys: str, buckets: int | None = None) -> DataFrame:
    """``df`` written once to the shared folder in buckets of ``keys``, sorted in them, and read back as a table.

    A join or an aggregation on ``keys`` with as many partitions reads it without an exchange, and so does one over a union
    of such tables. The table's name lives in the session's catalog, its files go with the application's folder.
    """
    spark = df.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"loom_{uuid.uuid4().hex}"
    dealt = df.repartition(buckets, *keys)
    dealt.write.bucketBy(buckets, *keys).sortBy(*keys).format("parquet").option("compression", "zstd").option("path", shared_dir(spark)).saveAsTable(name)
    return spark.table(name)
