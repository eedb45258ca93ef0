"""A graph store on Parquet: versioned tables of each graph, an append-only header log, and metadata.

``save`` writes all tables of a graph under a new version and then appends one header row; readers follow the newest
header, so a replacement is seen whole or not at all. Deletions append a row too; ``vacuum`` removes what no header names.
Columns that older files lack are null, and ``kind`` and ``relationship`` follow from the older ``type`` where they are.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

TABLES = ("nodes", "edges", "modules", "module_edges", "membership", "semantic_edges")
HEADER = "graph_id string, repo_path string, cir_version string, created_at timestamp, owner string, version string, deleted boolean"
VERSION = "cir.v1"
CODE = "code"


@dataclass
class Graph:
    """A graph as lazy tables; absent ones are None."""

    graph_id: str
    repo_path: str = ""
    tables: dict[str, DataFrame] = field(default_factory=dict)


def new_graph_id() -> str:
    return uuid.uuid4().hex[:12]


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._fs = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _exists(self, path: str) -> bool:
        return self._fs.exists(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path))

    def _log(self) -> DataFrame:
        path = f"{self.root}/headers"
        return self.spark.read.schema(HEADER).parquet(path) if self._exists(path) else self.spark.createDataFrame([], HEADER)

    def _append(self, rows: DataFrame) -> None:
        rows.coalesce(1).write.mode("append").parquet(f"{self.root}/headers")

    def headers(self) -> DataFrame:
        """The newest header of each graph that isn't deleted."""
        by = W.partitionBy("graph_id").orderBy(F.desc("created_at"), F.desc("version"))
        return self._log().withColumn("_r", F.row_number().over(by)).where("_r = 1 and not deleted").drop("_r")

    def header(self, graph_id: str) -> dict | None:
        row = self.headers().where(F.col("graph_id") == graph_id).first()
        return row.asDict() if row else None

    def save(self, graph: Graph, owner: str | None = None) -> str:
        """Replace a graph; without ``owner`` it keeps the one it had. Returns the version."""
        version = uuid.uuid4().hex
        for name, df in graph.tables.items():
            if name not in TABLES:
                raise KeyError(name)
            if name == "membership":
                df = df.dropDuplicates(["module", "id"])
            df.write.parquet(f"{self.root}/data/{graph.graph_id}/{version}/{name}")
        before = self.header(graph.graph_id)
        row = (graph.graph_id, graph.repo_path, VERSION, owner if owner is not None else before and before["owner"], version)
        self._append(self.spark.createDataFrame([row], "graph_id string, repo_path string, cir_version string, owner string, version string").select("graph_id", "repo_path", "cir_version", F.current_timestamp().alias("created_at"), "owner", "version", F.lit(False).alias("deleted")))
        return version

    def load(self, graph_id: str, code: bool = True) -> Graph | None:
        """A graph whole, or without the code of its nodes, which then isn't read; None where there is none."""
        head = self.header(graph_id)
        if head is None:
            return None
        tables = {}
        for name in TABLES:
            path = f"{self.root}/data/{graph_id}/{head['version']}/{name}"
            if self._exists(path):
                df = self.spark.read.option("mergeSchema", "true").parquet(path)
                tables[name] = upgraded(df, name).drop(*([] if code else [CODE]))
        return Graph(graph_id, head["repo_path"], tables)

    def load_light(self, graph_id: str) -> Graph | None:
        return self.load(graph_id, code=False)

    def list(self, owner: str | None = None) -> DataFrame:
        """Headers, newest first; with ``owner`` those without an owner and its own."""
        out = self.headers()
        return (out if owner is None else out.where(F.col("owner").isNull() | (F.col("owner") == owner))).orderBy(F.desc("created_at"), "graph_id")

    def owner(self, graph_id: str) -> str | None:
        head = self.header(graph_id)
        return head and head["owner"]

    def find_by_path(self, repo_path: str) -> str | None:
        row = self.headers().where(F.col("repo_path") == repo_path).orderBy(F.desc("created_at")).select("graph_id").first()
        return row and row[0]

    def _change(self, graph_id: str, **columns) -> bool:
        head = self.headers().where(F.col("graph_id") == graph_id)
        if head.isEmpty():
            return False
        self._append(head.withColumns({**{c: F.lit(v) for c, v in columns.items()}, "created_at": F.current_timestamp()}))
        return True

    def set_owner(self, graph_id: str, owner: str | None) -> bool:
        return self._change(graph_id, owner=owner)

    def set_repo_path(self, graph_id: str, repo_path: str) -> bool:
        return self._change(graph_id, repo_path=repo_path)

    def delete(self, graph_id: str) -> bool:
        return self._change(graph_id, deleted=True)

    def delete_older_than(self, cutoff_epoch: float) -> list[str]:
        """Delete graphs last saved before a time; returns their ids."""
        old = self.headers().where(F.col("created_at").cast("double") < cutoff_epoch)
        ids = [r[0] for r in old.select("graph_id").collect()]
        if ids:
            self._append(old.withColumns({"deleted": F.lit(True), "created_at": F.current_timestamp()}))
        return ids

    def vacuum(self) -> int:
        """Remove the files of versions that no header names; returns how many."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        live, gone = {(r[0], r[1]) for r in self.headers().select("graph_id", "version").collect()}, 0
        if not self._exists(f"{self.root}/data"):
            return 0
        for g in self._fs.listStatus(path(f"{self.root}/data")):
            for v in self._fs.listStatus(g.getPath()):
                if (g.getPath().getName(), v.getPath().getName()) not in live:
                    gone += self._fs.delete(v.getPath(), True)
        return gone

    def store_meta(self, graph_id: str, values: DataFrame) -> None:
        """Upsert metadata (key, value JSON) of a graph."""
        values.select(F.lit(graph_id).alias("graph_id"), "key", "value", F.current_timestamp().alias("ts"), F.expr("uuid()").alias("n")).write.mode("append").parquet(f"{self.root}/metadata")

    def metadata(self, graph_id: str) -> DataFrame:
        """(key, value): the newest value of each key."""
        path = f"{self.root}/metadata"
        if not self._exists(path):
            return self.spark.createDataFrame([], "key string, value string")
        rows = self.spark.read.parquet(path).where(F.col("graph_id") == graph_id)
        return rows.groupBy("key").agg(F.max_by("value", F.struct("ts", "n")).alias("value"))

    def load_meta(self, graph_id: str, key: str) -> str | None:
        row = self.metadata(graph_id).where(F.col("key") == key).first()
        return row and row["value"]

    def cached(self, graph_id: str, key: str, build, force: bool = False) -> str:
        """A graph's metadata value, built and kept where it is absent or ``force``; ``build()`` gives JSON."""
        value = None if force else self.load_meta(graph_id, key)
        if value is None:
            value = build()
            self.store_meta(graph_id, self.spark.createDataFrame([(key, value)], "key string, value string"))
        return value


def upgraded(df: DataFrame, table: str) -> DataFrame:
    """Older rows as today's: absent columns are null, ``kind`` and ``relationship`` follow from ``type``."""
    need = {"nodes": ("kind", "type", "summary", CODE), "edges": ("relationship", "type")}.get(table, ())
    for c in need:
        if c not in df.columns:
            df = df.withColumn(c, F.lit(None).cast("string"))
    if table == "nodes":
        old = F.when(F.col("type") == "class", "type").when(F.col("type").isin("function", "method"), "function").when(F.col("type") == "file", "file")
        return df.withColumn("kind", F.coalesce("kind", old))
    if table == "edges":
        old = F.when(F.col("type") == "CALLS", "INVOKES").when(F.col("type") == "IMPORTS", "DEPENDS_ON").when(F.col("type") == "INHERITS", "EXTENDS").when(F.col("type") == "DEFINES", "CONTAINS")
        return df.withColumn("relationship", F.coalesce("relationship", old))
    return df


def guard(nodes: DataFrame, most: int | None) -> int:
    """The number of nodes; an error where there are more than ``most``."""
    n = nodes.count()
    if most is not None and n > most:
        raise ValueError(f"the repository has {n} nodes, over the limit of {most}")
    return n
