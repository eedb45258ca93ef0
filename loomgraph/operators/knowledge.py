"""Documents beside code: sections, titles, links and mentions with confidences, developers' notes, node references.

Documents are (path, text); nodes have id, name, kind, file and, for notes, start and end line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vocabulary as V
from ..storage import dealt, written
from .intervals import innermost

HEADING = r"^(#{1,6})\s+(.+?)\s*#*\s*$"
LINK = r"\[[^\]]+\]\(([^)\s]+)\)"
SPAN = r"`([A-Za-z_][A-Za-z0-9_./]*(?:\(\))?)`"
IDENTIFIER = r"\b([a-z][a-z0-9]*(?:_[a-z0-9]+)+|[A-Z][a-z0-9]+(?:[A-Z][a-z0-9]+)+)\b"
FILE = r"\b([A-Za-z0-9_./-]+\.(?:py|js|jsx|ts|tsx|java|c|cc|cpp|h|hpp))\b"
#: Confidence of each kind of evidence.
CONFIDENCE = {"link": 0.95, "path span": 0.9, "name span": 0.85, "path": 0.8, "name": 0.6}
#: Ids that one name stands for at most: in a span, and in prose.
IN_SPAN, IN_PROSE = 3, 2


def lines(docs: DataFrame) -> DataFrame:
    """(path, line, text, code) of every line, from 1; ``code`` for a fence and what is inside one.

    Documents are dealt by path to all tasks first: their shuffled bytes are few, and one task would get all lines of them.
    """
    rows = dealt(docs, "path").select("path", F.posexplode(F.split("text", r"\r?\n")).alias("line", "text")).withColumn("line", F.col("line") + 1)
    fence = F.ltrim("text").startswith("```").cast("int")
    upto = F.sum(fence).over(W.partitionBy("path").orderBy("line"))
    return rows.withColumn("n", upto).select("path", "line", "text", ((F.col("n") % 2 == 1) | (fence == 1)).alias("code"))


def sections(rows: DataFrame) -> DataFrame:
    """(path, line, level, heading) of Markdown headings outside fences."""
    hit = rows.where(~F.col("code") & F.col("text").rlike(HEADING))
    return hit.select("path", "line", F.length(F.regexp_extract("text", HEADING, 1)).alias("level"), F.trim(F.regexp_extract("text", HEADING, 2)).alias("heading"))


def documents(docs: DataFrame) -> DataFrame:
    """(path, title, type, n_sections, n_words, summary): the first top heading or the file's stem; the first paragraph."""
    rows = lines(docs)
    found = sections(rows).groupBy("path").agg(F.count(F.lit(1)).alias("n_sections"), F.min_by("heading", F.when(F.col("level") == 1, F.col("line"))).alias("h"), F.max(F.col("level") == 1).alias("has"))
    stem = F.trim(F.translate(F.regexp_replace(T.file_name(F.col("path")), r"\.[^.]*$", ""), "_-", "  "))
    word_count = F.sum(F.size(F.filter(F.split("text", r"\s+"), lambda x: x != "")))
    flat = rows.withColumn("s", F.trim("text")).withColumn("prose", ~F.col("code") & (F.col("s") != "") & ~F.col("s").startswith("#"))
    first = flat.groupBy("path").agg(F.min(F.when(F.col("prose"), F.col("line"))).alias("a"), word_count.alias("n_words"))
    after = flat.join(first.select("path", "a"), "path").where("line >= a").groupBy("path").agg(F.min(F.when(~F.col("prose"), F.col("line"))).alias("b"))
    ends = first.join(after, "path", "left")
    part = flat.join(ends.select("path", "a", "b"), "path").where("line >= a and (b is null or line < b)")
    before = F.coalesce(F.sum(F.length("s")).over(W.partitionBy("path").orderBy("line").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    text = part.withColumn("n", before).where("n <= 240").groupBy("path").agg(F.array_sort(F.collect_list(F.struct("line", "s"))).alias("p"))
    text = text.select("path", F.substring(F.array_join(F.transform("p", lambda x: x["s"]), " "), 1, 300).alias("summary"))
    out = first.join(found, "path", "left").join(text, "path", "left")
    return out.select(
        "path", F.when(F.col("has"), F.col("h")).otherwise(F.when(stem == "", F.col("path")).otherwise(stem)).alias("title"), T.doc_type(F.col("path")).alias("type"),
        F.coalesce("n_sections", F.lit(0)).alias("n_sections"), "n_words", F.coalesce("summary", F.lit("")).alias("summary"),
    )


def normal_path(path: Column) -> Column:
    """A path without ".", ".." and doubled slashes; what leads above the root is kept as ".."."""
    def step(acc, part):
        up = (part == "..") & (F.size(acc) > 0) & (F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit("..")) != "..")
        return F.when(part.isin("", "."), acc).when(up, F.slice(acc, 1, F.size(acc) - 1)).otherwise(F.concat(acc, F.array(part)))

    return F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/")


def name_index(nodes: DataFrame, most: int = IN_SPAN) -> DataFrame:
    """(name, id, r): at most ``most`` symbols of each name of four characters or more; files and externals aren't symbols."""
    rows = nodes.where("kind not in ('external', 'file')").where(F.length("name") >= 4).select("name", "id")
    # each task sorts what it has by name; dealt by id, it has a share of a common name and not a small file's all
    return dealt(rows, "id").withColumn("r", F.row_number().over(W.partitionBy("name").orderBy("id"))).where(F.col("r") <= most)


def _found(rows: DataFrame, pattern: str, rule: int, column: str = "text") -> DataFrame:
    hit = rows.select("path", "line", "text", F.posexplode(F.regexp_extract_all(column, F.lit(pattern), F.lit(1))).alias("pos", "token"))
    return hit.select("path", "line", "text", F.lit(rule).alias("rule"), "pos", "token")


def doc_edges(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(path, type, target, line, section, confidence, evidence): links and mentions of each document outside fences.

    Of equal (type, target) in a document the first by line, kind of evidence and place stays. Links go to documents
    (LINKS_TO) or else files (MENTIONS_FILE); spans and prose to files or to symbols (REFERENCES).
    """
    rows = lines(docs)
    text = rows.where(~F.col("code"))
    files = nodes.where("kind <> 'external' and file <> ''").select(F.col("file").alias("token")).distinct()
    names = name_index(nodes)

    link = _found(text, LINK, 0).withColumn("href", F.regexp_extract("token", r"^([^#]*)", 1)).where("href <> ''").where(~F.col("href").rlike("^(https?://|mailto:)"))
    folder = F.regexp_extract("path", r"^(.*)/[^/]*$", 1)
    full = F.when((folder == "") | F.col("href").startswith("/"), F.col("href")).otherwise(F.concat_ws("/", folder, "href"))
    link = link.withColumn("token", F.regexp_replace(normal_path(full), r"^[./]+", ""))
    to_doc = link.join(docs.select(F.col("path").alias("token")).distinct(), "token", "left_semi").select("path", "line", "text", "rule", "pos", F.lit("LINKS_TO").alias("type"), F.concat(F.lit("doc::"), "token").alias("target"), F.lit(CONFIDENCE["link"]).alias("confidence"))
    rest = link.join(docs.select(F.col("path").alias("token")).distinct(), "token", "left_anti")

    def to_file(found: DataFrame, kind: str) -> DataFrame:
        return found.join(files, "token", "left_semi").select("path", "line", "text", "rule", "pos", F.lit("MENTIONS_FILE"), F.concat(F.lit("file::"), "token"), F.lit(CONFIDENCE[kind]))

    def to_name(found: DataFrame, kind: str, most: int, key: Column) -> DataFrame:
        hit = found.withColumn("name", key).join(names.where(F.col("r") <= most), "name")
        return hit.select("path", "line", "text", "rule", (F.col("pos") * 10 + F.col("r")).alias("pos"), F.lit("REFERENCES"), "id", F.lit(CONFIDENCE[kind]))

    span = _found(text, SPAN, 1).withColumn("token", F.regexp_replace("token", r"[()]+$", ""))
    short = F.regexp_extract("token", r"([^./]*)$", 1)
    edges = to_doc.union(to_file(rest, "link")).union(to_file(span, "path span"))
    edges = edges.union(to_name(span.join(files, "token", "left_anti"), "name span", IN_SPAN, short))
    edges = edges.union(to_name(_found(text, IDENTIFIER, 2), "name", IN_PROSE, F.col("token"))).union(to_file(_found(text, FILE, 3), "path"))
    first = dealt(edges, "path").groupBy("path", "type", "target").agg(F.min(F.struct("line", "rule", "pos", "confidence", F.substring(F.trim("text"), 1, 200).alias("evidence"))).alias("e"))
    return section_of(first.select("path", "type", "target", "e.line", "e.confidence", "e.evidence"), sections(rows))


def section_of(rows: DataFrame, heads: DataFrame) -> DataFrame:
    """``rows`` (path, line, ...) with the heading in force at their line, as ``section``: an as-of lookup by union and window."""
    rest = [c for c in rows.columns if c not in ("path", "line")]
    both = rows.select("path", "line", F.lit(1).alias("_k"), F.struct(*rest).alias("_r"), F.lit(None).cast("string").alias("_h"))
    both = both.union(heads.select("path", "line", F.lit(0), F.lit(None).cast(dict(both.dtypes)["_r"]), "heading"))
    last = F.last("_h", True).over(W.partitionBy("path").orderBy("line", "_k").rowsBetween(W.unboundedPreceding, 0))
    return dealt(both, "path").withColumn("section", last).where("_k = 1").select("path", "line", "_r.*", "section")


def rationale(sources: DataFrame, nodes: DataFrame, most: int = 500) -> DataFrame:
    """(id, marker, text, file, line, node): developers' notes with the innermost symbol around each; the first ``most`` by path.

    ``sources``: path, text. A note has a comment sign, a marker and at least eight characters after it.
    """
    pattern = r"(?i)(?:#|//|/\*|\*|<!--)\s*(" + "|".join(V.MARKERS) + r")\b[:\s-]*(.+)"
    rows = sources.select("path", F.posexplode(F.split("text", r"\r?\n")).alias("line", "text")).where(F.col("text").rlike(pattern))
    body = F.trim(F.regexp_replace(F.trim(F.regexp_extract("text", pattern, 2)), r"[*/\-> ]+$", ""))
    notes = rows.select("path", (F.col("line") + 1).alias("line"), F.upper(F.regexp_extract("text", pattern, 1)).alias("marker"), body.alias("text")).where(F.length("text") >= 8)
    notes = written(notes.orderBy("path", "line").limit(most))
    spans = nodes.where("kind not in ('external', 'file')").select(F.col("file").alias("path"), "start", "end", F.col("id").alias("node"))
    spans = spans.join(F.broadcast(notes.select("path").distinct()), "path", "left_semi")  # the files of at most ``most`` notes
    best = innermost(notes, spans, "path", "line", "start", "end", "node")
    return best.select(F.concat_ws("::", F.lit("rationale"), "path", "line").alias("id"), "marker", F.substring("text", 1, 300).alias("text"), F.col("path").alias("file"), "line", "node")


def search_rationale(notes: DataFrame, query: str = "", marker: str = "", most: int = 20) -> DataFrame:
    """Notes of a marker, with a text in their text or path."""
    out = notes.where(F.col("marker") == marker.upper()) if marker else notes
    q = query.lower()
    return out.where(F.lower("text").contains(q) | F.lower("file").contains(q)).orderBy("file", "line").limit(most)


def node_references(node: str, nodes: DataFrame, edges: DataFrame, doc_links: DataFrame, docs: DataFrame, notes: DataFrame, semantic: DataFrame | None = None) -> dict[str, DataFrame]:
    """What is known about one node: ``referenced_in`` (20), ``rationale`` (20) and ``edges`` (40) with provenance.

    ``edges``: src, dst, adapter, confidence, callee; ``doc_links`` and ``docs`` as made above; ``semantic``: src, dst,
    type, confidence, inferred_by. Direct references come first, then by confidence.
    """
    at = nodes.where(F.col("id") == node).select("id", "file", "kind").first()
    if at is None:
        raise KeyError(node)
    direct = F.col("target") == node
    refs = doc_links.where(direct | (F.col("target") == f"file::{at['file']}")).withColumn("direct", direct)
    refs = refs.join(docs.select("path", "title", F.col("type").alias("doc_type")), "path")
    refs = refs.orderBy(F.desc("direct"), F.desc("confidence"), "path", "line").limit(20).select("title", "path", "doc_type", "section", "line", "direct", "confidence")
    own = F.col("node") == node
    if at["kind"] == "file":
        own = own | (F.col("node").isNull() & (F.col("file") == at["file"]))
    source, confidence = T.provenance(F.col("adapter"), F.col("confidence"), F.col("callee"))
    calls = edges.where((F.col("src") == node) | (F.col("dst") == node)).select("src", "dst", F.lit("CALLS").alias("type"), source.alias("source"), confidence.alias("confidence"))
    if semantic is not None:
        calls = calls.union(semantic.where((F.col("src") == node) | (F.col("dst") == node)).select("src", "dst", "type", T.semantic_provenance(F.col("inferred_by")), "confidence"))
    out = F.col("src") == node
    calls = calls.withColumn("direction", F.when(out, "out").otherwise("in")).withColumn("other_id", F.when(out, F.col("dst")).otherwise(F.col("src")))
    calls = calls.join(nodes.select(F.col("id").alias("other_id"), F.col("name").alias("n")), "other_id", "left")
    calls = calls.select("direction", F.coalesce("n", "other_id").alias("other"), "type", "source", "confidence").orderBy("direction", "other", "type").limit(40)
    return {"referenced_in": refs, "rationale": notes.where(own).orderBy("file", "line").limit(20), "edges": calls}


def references_per_doc(links: DataFrame) -> DataFrame:
    return links.groupBy("path").agg(F.count(F.lit(1)).alias("n_references"))
