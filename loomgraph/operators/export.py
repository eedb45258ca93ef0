"""Exports of a graph: JSON, Mermaid, suggested questions, the Markdown report, and the one-call bundle.

    python -m loomgraph.operators.export FOLDER [--depth 3] [--most 80]
"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vocabulary as V
from ..storage import written
from . import graph as G

NODES, EDGES = 80, 500
# Questions by project type.
QUESTIONS = {
    "web_api": ("Which functions expose API endpoints?", "How are requests validated?"),
    "cli_tool": ("What happens when the CLI is invoked?",),
    "data_pipeline": ("How does data flow from ingestion to output?",),
    "library": ("What is the public API surface of this library?",),
}


def top_nodes(nodes: DataFrame, edges: DataFrame, most: int = NODES, edges_most: int = EDGES) -> tuple[DataFrame, DataFrame]:
    """The ``most`` nodes (id, fan_in, fan_out, ...) of highest degree and the first edges among them."""
    keep = nodes.orderBy(F.desc(F.col("fan_in") + F.col("fan_out")), "id").limit(most)
    return keep, G.induced(edges, keep).orderBy("src", "dst").limit(edges_most)


def json_rows(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(part, key, json) of nodes and edges."""
    n = nodes.select(F.lit("node").alias("part"), F.col("id").alias("key"), F.to_json(F.struct(*nodes.columns)).alias("json"))
    return n.union(edges.select(F.lit("edge"), F.concat_ws(">", "src", "dst"), F.to_json(F.struct("src", "dst"))))


def mermaid_rows(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(line): nodes as n1, n2, ... by degree with a class of their semantic kind, then edges."""
    named = nodes.withColumn("n", F.concat(F.lit("n"), F.row_number().over(W.orderBy(F.desc(F.col("fan_in") + F.col("fan_out")), "id"))))  # NODES rows
    box = named.select(F.concat("n", F.lit('["'), F.replace("name", F.lit('"'), F.lit("'")), F.lit('"]:::'), F.lower("semantic_kind")).alias("line"))
    ends = edges.join(named.select(F.col("id").alias("src"), F.col("n").alias("s")), "src").join(named.select(F.col("id").alias("dst"), F.col("n").alias("t")), "dst")
    return box.union(ends.select(F.concat_ws(" --> ", "s", "t")))


def questions(god_nodes: DataFrame, project_type: str, cycles: DataFrame | None = None, notes: DataFrame | None = None, most: int = 8) -> DataFrame:
    """(pos, question): about the three most central nodes, the project's type, the first cycle, the first workaround, storage."""
    out = [f"What does `{r['id']}` do and what depends on it?" for r in god_nodes.orderBy(F.desc("score"), "id").limit(3).collect()]
    out += QUESTIONS.get(project_type, ())
    first = cycles.orderBy("length", "path").first() if cycles is not None else None
    if first:
        path = first["path"].split(">")
        out.append(f"Why do `{path[0]}` and `{path[-1]}` depend on each other?")
    hack = notes.where(F.col("marker").isin("HACK", "FIXME")).orderBy("file", "line").first() if notes is not None else None
    if hack:
        out.append(f"What is the workaround in `{hack['file']}` about?")
    out.append("Where is data persisted?")
    return god_nodes.sparkSession.createDataFrame([(k + 1, q) for k, q in enumerate(out[:most])], "pos int, question string")


def report(parts: dict[str, DataFrame], project_type: str) -> DataFrame:
    """(section, pos, line) of the report; each section is a top list of its table, so this stays small.

    A section is written before the next begins: the driver holds the plan and the broadcasts of one at a time.

    Caps: 15 central nodes, 8 bridges, 10 risks, 10 cycles, 15 unused, 10 couplings, 15 documents, 12 notes, 8 questions.
    """
    tick = lambda c: F.concat(F.lit("`"), F.col(c), F.lit("`"))
    say = lambda *cs: F.concat(F.lit("- "), *cs)
    path = F.concat(F.array_join(F.transform(F.split("path", ">"), lambda x: F.concat(F.lit("`"), x, F.lit("`"))), " → "), F.lit(" → `"), F.split("path", ">")[0], F.lit("`"))
    refs = F.coalesce("n_references", F.lit(0))
    plan = [
        ("Most Important Functions", "god_nodes", 15, [F.desc("score"), F.col("id")], F.concat(F.lit("| "), tick("id"), F.lit(" | "), F.concat_ws(" | ", "in_degree", "out_degree", "pagerank"), F.lit(" |"))),
        ("Architectural Bottlenecks", "bridges", 8, [F.desc("degree"), F.col("id")], say(tick("id"), F.lit(" — degree "), "degree")),
        ("High-Risk Components", "high_risk", 10, [F.desc(F.col("fan_in") + F.col("fan_out")), F.col("id")], say(tick("name"), F.lit(" ("), "file", F.lit(") — "), "reasons")),
        ("Circular Dependencies", "cycles", 10, [F.col("length"), F.col("path")], say(path)),
        ("Dead Code Candidates", "dead_code", 15, [F.col("id")], say(tick("name"), F.lit(" ("), "file", F.lit(")"))),
        ("Surprising Couplings", "couplings", 10, [F.col("n"), F.col("src"), F.col("dst")], say(tick("src"), F.lit(" → "), tick("dst"), F.lit(" ("), T.plural(F.col("n"), "edge"), F.lit(", e.g. "), "example", F.lit(")"))),
        ("Documentation Map", "documents", 15, [F.desc(refs), F.col("path")], say("title", F.lit(" ("), "path", F.lit(", "), "type", F.lit(") — "), T.plural(refs, "code reference"))),
        ("Developer Rationale", "notes", 12, [F.col("file"), F.col("line")], say("marker", F.when(F.col("node").isNotNull(), F.concat(F.lit(" (in "), "node", F.lit(")"))).otherwise(""), F.lit(" — "), "text", F.lit(" "), "file", F.lit(":"), F.col("line").cast("string"))),
    ]
    out = None
    for title, name, most, order, line in plan:
        if name not in parts:
            continue
        rows = parts[name].where(F.col("marker").isin(*V.SHOWN_MARKERS)) if name == "notes" else parts[name]
        top = rows.orderBy(*order).limit(most)
        top = written(top.select(F.lit(title).alias("section"), F.row_number().over(W.orderBy(*order)).alias("pos"), line.alias("line")))
        out = top if out is None else out.union(top)
    asked = questions(parts["god_nodes"], project_type, parts.get("cycles"), parts.get("notes"))
    return out.union(asked.select(F.lit("Suggested Questions"), "pos", say("question")))


def bundle(spark: SparkSession, folder: str, depth: int = 3, most: int | None = None, view: bool = True) -> dict:
    """A folder's graph in one call: counts, nodes, edges, and a view of its modules."""
    from ..sources import extract, store
    from . import modules as M
    from . import resolve

    nodes, edges = resolve.graph_of(extract.extract(extract.scan_files(spark, folder)))
    nodes = nodes.withColumnsRenamed({"path": "file"}).withColumns({"intent": T.intent(F.col("name"))})
    n = store.guard(nodes, most)
    calls = edges.where("relationship = 'INVOKES'").select("src", "dst")
    out = {"schema": "loomgraph.bundle.v1", "cir_version": store.VERSION, "repo_path": folder, "stats": {"node_count": n, "edge_count": edges.count(), "call_count": calls.count()}}
    keep = nodes.select("id", "name", "kind", "type", "file", "line", "end_line", "summary") if "summary" in nodes.columns else nodes.select("id", "name", "kind", "type", "file", "line", "end_line")
    out["nodes"] = [json.loads(x) for x in keep.orderBy("id").toJSON().collect()]  # the document that was asked for
    out["edges"] = [json.loads(x) for x in edges.orderBy("src", "dst").toJSON().collect()]
    if view:
        members = M.membership(nodes, G.communities(nodes, calls))
        a, b = M.view(nodes, members, calls, depth)
        out["view"] = {"depth": depth, "nodes": [r.asDict() for r in a.collect()], "edges": [r.asDict() for r in b.collect()]}
    return out


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(description="The graph of a source folder as JSON.")
    p.add_argument("folder")
    p.add_argument("--depth", type=int, default=3, choices=(1, 2, 3))
    p.add_argument("--most", type=int)
    args = p.parse_args(argv)
    from ..session import local_session

    json.dump(bundle(local_session(), args.folder, args.depth, args.most), sys.stdout, indent=1)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
