"""Symbolic edges to nodes: at most one target each, by tiers of unique keys; and edge hygiene."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..storage import bucketed, written
from .search import NameIndex


def _unique(rows: DataFrame, *keys: str, alias: str) -> DataFrame:
    """Keys that exactly one id has, with it: a join on them cannot multiply rows."""
    return rows.groupBy(*keys).agg(F.countDistinct("id").alias("_n"), F.min("id").alias(alias)).where("_n = 1").drop("_n")


def _with(df: DataFrame, *names: str) -> DataFrame:
    """``df`` with missing columns as nulls."""
    return df.select("*", *[F.lit(None).cast("string").alias(n) for n in names if n not in df.columns])


def resolve_calls(edges: DataFrame, nodes: DataFrame, attrs: DataFrame | None = None, imports: DataFrame | None = None) -> DataFrame:
    """(id, target_id, confidence, line): each symbolic call's one target; calls without one, and self-calls, go.

    Tiers: 1 ``self.f`` in the enclosing class (0.95); 2 ``self.x.f`` by the recorded type of x (0.90); 3 a receiver that
    is a class (0.85); 4 a receiver that is an imported module's name, by the one file of that stem with such a function
    (0.90); 5 a bare name in the same file (0.80, other languages 0.65); 6 the one function of that name anywhere (0.65
    and 0.50 bare, 0.55 with a receiver). Classes of one name (their inheritance) resolve by ``resolve_bases``.

    ``edges``: id, target, receiver, line and, if there, owner (dotted), path and adapter (else Python). ``nodes``: id,
    name, kind, path and, if there, type. ``attrs``: path, owner, name, target; ``imports``: path, name, target.
    """
    e, n = _with(edges, "owner", "path", "adapter"), _with(nodes, "type")
    python = F.coalesce("adapter", F.lit("python_ast")) == "python_ast"
    e = e.withColumn("_path", F.coalesce("path", F.split("id", "::")[0])).withColumn("_python", python).withColumn("receiver", F.when(F.col("receiver") != "", F.col("receiver")))
    e = e.withColumn("_owner", F.coalesce("owner", F.regexp_extract("id", r"::(.*)\.[^.:]+$", 1)))
    function = F.coalesce(F.col("type") == "function", (F.col("kind") == "function"))
    own = n.select(F.col("id").alias("t1")).distinct()
    suffix = F.regexp_extract("id", r"([^.:]+\.[^.:]+)$", 1)
    method = _unique(n.withColumn("_suffix", suffix).where("_suffix <> ''"), "_suffix", alias="m")
    local = n.where(function).groupBy(F.col("path").alias("_path"), F.col("name").alias("target")).agg(F.max("id").alias("t5"))
    everywhere = _unique(n.where(function), "name", alias="t6").withColumnRenamed("name", "target")
    bare, on_self = F.col("receiver").isNull(), F.col("receiver") == "self"
    plain = F.col("_python") & ~bare & ~F.col("receiver").contains(".") & ~F.col("receiver").isin("self", "cls")

    e = e.withColumn("_k", F.when(F.col("_python") & on_self & (F.col("_owner") != ""), F.concat(F.col("_path"), F.lit("::"), "_owner", F.lit("."), "target"))).join(own, F.col("_k") == F.col("t1"), "left")
    if attrs is not None:
        kinds = attrs.groupBy(F.col("path").alias("_path"), F.col("owner").alias("_owner"), F.col("name").alias("_attr")).agg(F.max_by("target", "line").alias("_type"))
        e = e.withColumn("_attr", F.when(F.col("_python"), F.regexp_extract("receiver", r"^self\.(.+)$", 1))).join(kinds, ["_path", "_owner", "_attr"], "left")
        e = e.withColumn("_s", F.when(F.col("_type").isNotNull(), F.concat_ws(".", "_type", "target"))).join(method.toDF("_s", "t2"), "_s", "left").drop("_s")
    else:
        e = e.withColumn("t2", F.lit(None).cast("string"))
    e = e.withColumn("_s", F.when(plain, F.concat_ws(".", "receiver", "target"))).join(method.toDF("_s", "t3"), "_s", "left").drop("_s")
    if imports is not None:
        stems = _unique(n.where(function).withColumn("_stem", F.regexp_extract("path", r"([^/]*?)(?:\.[^./]*)?$", 1)), "_stem", "name", alias="t4").withColumnRenamed("name", "target")
        alias = imports.groupBy(F.col("path").alias("_path"), F.col("name").alias("_alias")).agg(F.max_by("target", "line").alias("_full"))
        e = e.withColumn("_alias", F.when(plain, F.col("receiver"))).join(alias, ["_path", "_alias"], "left")
        e = e.withColumn("_stem", F.regexp_extract("_full", r"([^.]*)$", 1)).join(stems, ["_stem", "target"], "left")
    else:
        e = e.withColumn("t4", F.lit(None).cast("string"))
    e = e.join(local, ["_path", "target"], "left").join(everywhere, "target", "left")
    tier = lambda c, ok, p: F.when(ok & F.col(c).isNotNull(), F.struct(F.col(c).alias("t"), p.alias("p")))
    yes, by = F.lit(True), lambda a, b: F.when(F.col("_python"), a).otherwise(b)
    best = F.coalesce(tier("t1", yes, F.lit(0.95)), tier("t2", yes, F.lit(0.90)), tier("t3", yes, F.lit(0.85)), tier("t4", yes, F.lit(0.90)), tier("t5", bare, by(0.80, 0.65)), tier("t6", bare, by(0.65, 0.50)), tier("t6", ~bare, F.lit(0.55)))
    found = e.select("id", best.alias("b"), "line").where("b is not null and b.t <> id")
    return found.select("id", F.col("b.t").alias("target_id"), F.col("b.p").alias("confidence"), "line")


def resolve_bases(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, target_id): each base class by the one class of that name."""
    one = _unique(nodes.where("kind = 'type'"), "name", alias="target_id")
    return edges.where("relation = 'EXTENDS'").select("id", F.regexp_extract("target", r"([^.:]+)$", 1).alias("name")).join(one, "name").where("id <> target_id").select("id", "target_id")


def by_name(asked: DataFrame, nodes: DataFrame) -> DataFrame:
    """(q, id, tier) of asked names (q): 0 exact, 1 without case, 2 as a prefix; the first node of the best tier.

    Nodes (id, name) are reduced to one a name first. Each tier asks only for what the one before left; prefixes are looked
    up in a trigram index of the names, by their rarest trigram.
    """
    one = nodes.groupBy("name").agg(F.min("id").alias("id"))
    exact = asked.join(one.withColumnRenamed("name", "q"), "q").select("q", "id", F.lit(0).alias("tier"))
    rest = asked.join(exact.select("q"), "q", "left_anti")
    low = one.groupBy(F.lower("name").alias("k")).agg(F.min("id").alias("id"))
    loose = rest.withColumn("k", F.lower("q")).join(low, "k").select("q", "id", F.lit(1).alias("tier"))
    rest = rest.join(loose.select("q"), "q", "left_anti").where("q <> ''")
    head = NameIndex.build(low.withColumnRenamed("k", "name")).by_prefix(rest).select("q", "id", F.lit(2).alias("tier"))
    return exact.union(loose).union(head)


def external_modules(imports: DataFrame) -> DataFrame:
    """(id, name): a node for each imported module."""
    return imports.select(F.concat(F.lit("external::module::"), "target").alias("id"), F.col("target").alias("name")).distinct()


def extra_edges(edges: DataFrame, found: DataFrame, nodes: DataFrame) -> DataFrame:
    """``edges`` (src, dst) and those of another analysis that have both ends, aren't loops and are new."""
    known = nodes.select("id")
    more = found.where("src <> dst").join(known.toDF("src"), "src", "left_semi").join(known.toDF("dst"), "dst", "left_semi").join(edges.select("src", "dst"), ["src", "dst"], "left_anti")
    return edges.select("src", "dst").union(more.select("src", "dst").distinct())


def graph_of(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and resolved edges (src, dst, relationship, confidence) of extracted rows: ids made unique, first edge of each kind.

    Rows and nodes are written once: every tier asks for them, and a plan would parse all files for each.
    """
    rows = written(rows)
    nodes = written(disambiguate(rows.where("row = 'node'"), "id", "line"))
    symbolic = rows.where("row = 'edge' and relation = 'INVOKES'").select("id", "target", "receiver", "owner", "path", "adapter", "line")
    attrs, imports = rows.where("row = 'attr'"), rows.where("row = 'import'")
    calls = resolve_calls(symbolic, nodes, attrs.select("path", "owner", "name", "target", "line"), imports.select("path", "name", "target", "line"))
    calls = calls.select(F.col("id").alias("src"), F.col("target_id").alias("dst"), F.lit("INVOKES").alias("relationship"), "confidence", "line")
    inside = rows.where("row = 'edge' and relation = 'CONTAINS'").select("id", "target", "relation", F.lit(1.0), "line")
    bases = resolve_bases(rows.where("row = 'edge'"), nodes).select("id", "target_id", F.lit("EXTENDS"), F.lit(0.65), F.lit(0))
    outside = imports.select("id", F.concat(F.lit("external::module::"), "target"), "relation", F.lit(1.0), "line")
    every = first_per(calls.union(inside).union(bases).union(outside), ["src", "dst", "relationship"], "line")
    return nodes, every.drop("line")


def file_imports(rows: DataFrame) -> DataFrame:
    """(sf, tf): files that import another file of the repository, by the module's path."""
    stem = lambda c: F.regexp_replace(F.regexp_replace(F.col(c), r"\.[^./]*$", ""), "/", ".")
    files = rows.where("row = 'node' and kind = 'file'").select(F.col("path").alias("tf"), stem("path").alias("m"))
    asked = rows.where("row = 'import'").select(F.col("path").alias("sf"), F.explode(F.array("target", F.regexp_replace("target", r"\.[^.]*$", ""))).alias("m")).distinct()
    return asked.join(files, "m").where("sf <> tf").select("sf", "tf").distinct()


def first_per(df: DataFrame, keys: list[str], *order) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("_r", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_r = 1").drop("_r")


def disambiguate(df: DataFrame, id_col: str, line_col: str) -> DataFrame:
    """Ids made unique: from the second of an id on, ``#line`` is appended."""
    r = F.row_number().over(W.partitionBy(id_col).orderBy(line_col))
    return df.withColumn("_r", r).withColumn(id_col, F.when(F.col("_r") > 1, F.concat_ws("#", id_col, line_col)).otherwise(F.col(id_col))).drop("_r")


def merge(old: DataFrame, new: DataFrame, changed: DataFrame, key: str) -> DataFrame:
    """Rows of ``old`` outside the changed keys, and all of ``new``."""
    return old.join(changed.select(key).distinct(), key, "left_anti").unionByName(new)


def merge_graph(nodes: DataFrame, edges: DataFrame, new_nodes: DataFrame, new_edges: DataFrame, changed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A graph after files (path) changed: nodes of other files and the new ones; edges whose ends are both kept, and the new ones."""
    kept = nodes.join(changed.select("path").distinct(), "path", "left_anti")
    ids = kept.select("id")
    old = edges.join(ids.toDF("src"), "src", "left_semi").join(ids.toDF("dst"), "dst", "left_semi")
    return kept.unionByName(new_nodes), old.select(*edges.columns).unionByName(new_edges).distinct()


def name_index(calls: DataFrame) -> DataFrame:
    """Symbolic calls laid out by the name they ask for: who asked for a name is read from its bucket."""
    return bucketed(calls, "target")


def update_calls(
    asked: DataFrame, edges: DataFrame, nodes: DataFrame, new_asked: DataFrame, new_nodes: DataFrame, changed: DataFrame, attrs: DataFrame | None = None, imports: DataFrame | None = None
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(asked, edges, nodes) after files (path) changed, as if all files were resolved anew.

    ``asked`` are all symbolic calls (``name_index``), ``edges`` what they resolved to (id, target_id, confidence, line);
    ``new_asked`` and ``new_nodes`` come from the changed files alone, ``attrs`` and ``imports`` are those of all files now. A
    call's candidates have the name it asks for. So only calls of changed files, and calls anywhere of a name that nodes of
    changed files lost or gained, are resolved again; all other edges stay.
    """
    gone = changed.select("path").distinct()
    what = [c for c in ("id", "name", "kind", "type", "path") if c in nodes.columns]
    before, after = nodes.join(gone, "path", "left_semi").select(*what), new_nodes.select(*what)
    touched = written(before.exceptAll(after).union(after.exceptAll(before)).select(F.col("name").alias("target")).distinct())
    kept = nodes.join(gone, "path", "left_anti")
    now = kept.unionByName(new_nodes, allowMissingColumns=True)
    others = asked.join(gone, "path", "left_anti")
    again = others.join(touched, "target", "left_semi").unionByName(new_asked, allowMissingColumns=True)
    redone = resolve_calls(again, now, attrs, imports)
    name = nodes.select(F.col("id").alias("target_id"), F.col("name").alias("target")).distinct()
    source = nodes.select("id", "path").distinct()
    stay = edges.join(name, "target_id").join(touched, "target", "left_anti").join(source, "id").join(gone, "path", "left_anti").select(*redone.columns)
    return others.unionByName(new_asked, allowMissingColumns=True), stay.union(redone), now


def semantic_edges(found: DataFrame, nodes: DataFrame) -> DataFrame:
    """(src, dst, type, confidence, inferred_by) of edges inferred to names; of equal names the last node counts, never itself.

    ``found``: src, target_name, type, confidence. Over 0.5 a model inferred it, else heuristics.
    """
    last = nodes.groupBy(F.col("name").alias("target_name")).agg(F.max("id").alias("dst"))
    out = found.join(last, "target_name").where("src <> dst")
    return out.select("src", "dst", "type", "confidence", F.when(F.col("confidence") > 0.5, "bob").otherwise("heuristic").alias("inferred_by"))
