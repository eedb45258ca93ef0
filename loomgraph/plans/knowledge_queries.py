"""Documents beside code made of suppliers and parts: sections, links, mentions, notes and references, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vocabulary as V
from ..operators import knowledge as K
from ..storage import written
from . import adapters as A
from .registry import registry

QUERIES, SQL, query = registry(__name__)


def _snake(c: str) -> Column:
    return F.replace(F.col(c), F.lit(" "), F.lit("_"))


def _camel(c: str) -> Column:
    return F.replace(F.initcap(c), F.lit(" "), F.lit(""))


def _file() -> Column:
    return F.concat(F.lit("parts/"), F.lower("p_type"), F.lit("/item"), F.col("p_partkey"), F.lit(".py"))


def sources(spark: SparkSession, d: str) -> DataFrame:
    """A source file of each part: a class, a function in it, and a developer's note at one of three lines."""
    p = A.load(spark, d, "part")
    marker = F.coalesce(F.get(F.array(*map(F.lit, V.MARKERS)), (F.col("p_partkey") % 11).cast("int")), F.lit("SAVE"))
    note = F.concat(F.lit("# "), marker, F.lit(": look at "), F.col("p_partkey"), F.when(F.col("p_partkey") % 3 == 0, "").otherwise(" again"))
    text = F.concat(F.lit("class "), _camel("p_name"), F.lit(":\n    def "), _snake("p_name"), F.lit("(self):\n        "), note, F.lit("\n        return 1\n"), F.when(F.col("p_partkey") % 5 == 0, note).otherwise(""))
    return p.select(_file().alias("path"), text.alias("text"))


def symbols(spark: SparkSession, d: str) -> DataFrame:
    """The classes and functions in those files, with their first and last line."""
    p = A.load(spark, d, "part")
    c = p.select(F.concat(_file(), F.lit("::"), _camel("p_name")).alias("id"), _camel("p_name").alias("name"), F.lit("type").alias("kind"), _file().alias("file"), F.lit(1).alias("start"), F.lit(4).alias("end"))
    return c.union(p.select(F.concat(_file(), F.lit("::"), _camel("p_name"), F.lit("."), _snake("p_name")), _snake("p_name"), F.lit("callable"), _file(), F.lit(2), F.lit(4)))


def docs(spark: SparkSession, d: str) -> DataFrame:
    """A Markdown document of each supplier, about the parts of the next keys."""
    s, p = A.load(spark, d, "supplier").select(F.col("s_suppkey").alias("k")), A.load(spark, d, "part")
    part = p.select("p_partkey", _snake("p_name").alias("snake"), _camel("p_name").alias("camel"), _file().alias("f"))
    for n in range(3):
        s = s.join(part.toDF("p", f"snake{n}", f"camel{n}", f"f{n}"), F.col("k") + n == F.col("p")).drop("p")
    kind = F.col("k") % 4
    name = lambda before, k, after: F.concat(F.lit(before), k.cast("string"), F.lit(after))
    k = F.col("k")
    path = F.when(kind == 0, name("README_", k, ".md")).when(kind == 1, name("docs/guide_", k, ".md")).when(kind == 2, name("docs/adr/adr-", k, ".md")).otherwise(name("wiki/page_", k, ".md"))
    to = F.when(kind == 0, name("docs/guide_", k + 1, ".md")).when(kind == 1, name("./guide_", k + 4, ".md#top")).when(kind == 2, name("../guide_", k - 1, ".md")).otherwise(name("../README_", k + 1, ".md"))
    up = F.when(kind == 0, "").when(kind == 2, "../../").otherwise("../")
    text = F.concat(
        F.when(k % 3 == 0, "# Supplier ").otherwise("## Supplier "), k.cast("string"), F.lit("\n\nUses `"), "snake0", F.lit("()` and `"), "f0", F.lit("` daily.\nSee [next]("), to, F.lit(") and [code]("), up, "f1",
        F.lit("#top) or [web](https://example.org/x).\n## Details ##\n```\n"), "snake1", F.lit(" in a fence\n```\nProse names "), "snake1", F.lit(" and "), "camel2", F.lit(" plus "), "f2", F.lit(" here."),
    )
    return s.select(path.alias("path"), text.alias("text"))


_PART = "SELECT p_partkey AS k, replace(p_name, ' ', '_') AS snake, array_to_string([upper(x[1]) || x[2:] FOR x IN string_split(p_name, ' ')], '') AS camel, 'parts/' || lower(p_type) || '/item' || p_partkey || '.py' AS f FROM part"
_MARKER = "CASE k % 11 " + " ".join(f"WHEN {i} THEN '{m}'" for i, m in enumerate(V.MARKERS)) + " ELSE 'SAVE' END"
_CTE = (
    f"WITH pt AS ({_PART}), sy AS (SELECT f || '::' || camel AS id, camel AS name, 'type' AS kind, f AS file, 1 AS start, 4 AS stop FROM pt UNION ALL SELECT f || '::' || camel || '.' || snake, snake, 'callable', f, 2, 4 FROM pt), "
    "md AS (SELECT s.s_suppkey AS k, CASE s.s_suppkey % 4 WHEN 0 THEN 'README_' || s.s_suppkey || '.md' WHEN 1 THEN 'docs/guide_' || s.s_suppkey || '.md' WHEN 2 THEN 'docs/adr/adr-' || s.s_suppkey || '.md' ELSE 'wiki/page_' || s.s_suppkey || '.md' END AS path, "
    "CASE WHEN s.s_suppkey % 3 = 0 THEN '# Supplier ' ELSE '## Supplier ' END || s.s_suppkey || chr(10) || chr(10) || 'Uses `' || a.snake || '()` and `' || a.f || '` daily.' || chr(10) || 'See [next](' || CASE s.s_suppkey % 4 WHEN 0 THEN 'docs/guide_' || (s.s_suppkey + 1) || '.md' WHEN 1 THEN './guide_' || (s.s_suppkey + 4) || '.md#top' WHEN 2 THEN '../guide_' || (s.s_suppkey - 1) || '.md' ELSE '../README_' || (s.s_suppkey + 1) || '.md' END "
    "|| ') and [code](' || CASE s.s_suppkey % 4 WHEN 0 THEN '' WHEN 2 THEN '../../' ELSE '../' END || b.f || '#top) or [web](https://example.org/x).' || chr(10) || '## Details ##' || chr(10) || '```' || chr(10) || b.snake || ' in a fence' || chr(10) || '```' || chr(10) || 'Prose names ' || b.snake || ' and ' || c.camel || ' plus ' || c.f || ' here.' AS text "
    "FROM supplier s JOIN pt a ON a.k = s.s_suppkey JOIN pt b ON b.k = s.s_suppkey + 1 JOIN pt c ON c.k = s.s_suppkey + 2), "
    "ln AS (SELECT path, unnest(range(1, len(p) + 1))::INT AS line, unnest(p) AS text FROM (SELECT path, string_split(text, chr(10)) AS p FROM md)), "
    "lf AS (SELECT *, starts_with(ltrim(text), '```') AS fence, sum(starts_with(ltrim(text), '```')::INT) OVER (PARTITION BY path ORDER BY line) % 2 = 1 AS open FROM ln), tx AS (SELECT path, line, text FROM lf WHERE NOT fence AND NOT open), "
    r"sec AS (SELECT path, line, length(regexp_extract(text, '^(#{1,6})\s', 1)) AS level, trim(regexp_extract(text, '^#{1,6}\s+(.+?)\s*#*\s*$', 1)) AS heading FROM tx WHERE regexp_matches(text, '^#{1,6}\s+.+'))"
)


@query(_CTE + " SELECT path, line, level::INT AS level, heading FROM sec")
def doc_sections(spark: SparkSession, d: str) -> DataFrame:
    """Headings outside fences, with their level."""
    return K.sections(K.lines(docs(spark, d)))


@query(
    _CTE
    + r""", head AS (SELECT path, count(*) AS n_sections, arg_min(heading, line) FILTER (level = 1) AS h FROM sec GROUP BY path),
words AS (SELECT path, sum(len(list_filter(string_split(text, ' '), lambda x: x <> '')))::BIGINT AS n_words FROM ln GROUP BY path),
prose AS (SELECT path, line, trim(text) AS s, NOT fence AND NOT open AND trim(text) <> '' AND NOT starts_with(trim(text), '#') AS prose FROM lf),
first AS (SELECT path, min(line) FILTER (prose) AS a FROM prose GROUP BY path), last AS (SELECT path, min(line) FILTER (NOT prose AND line > a) AS b FROM prose JOIN first USING (path) GROUP BY path),
summary AS (SELECT path, left(string_agg(s, ' ' ORDER BY line), 300) AS summary FROM prose JOIN first USING (path) JOIN last USING (path) WHERE line >= a AND line < b GROUP BY path)
SELECT md.path, coalesce(h, replace(replace(regexp_extract(md.path, '([^/]*)\.md$', 1), '_', ' '), '-', ' ')) AS title, CASE k % 4 WHEN 0 THEN 'readme' WHEN 1 THEN 'guide' WHEN 2 THEN 'adr' ELSE 'wiki' END AS type, coalesce(n_sections, 0) AS n_sections, n_words, summary FROM md LEFT JOIN head USING (path) JOIN words USING (path) JOIN summary USING (path)"""
)
def document_index(spark: SparkSession, d: str) -> DataFrame:
    """Title, type, sections, words and summary of each document."""
    return K.documents(docs(spark, d))


_EDGES = (
    _CTE
    + r""", fl AS (SELECT DISTINCT file FROM sy), ix AS (SELECT name, id, row_number() OVER (PARTITION BY name ORDER BY id) AS r FROM sy WHERE length(name) >= 4 QUALIFY row_number() OVER (PARTITION BY name ORDER BY id) <= 3),
l0 AS (SELECT path, line, text, unnest(range(len(h))) AS pos, unnest(h) AS token FROM (SELECT *, regexp_extract_all(text, '\[[^\]]+\]\(([^)\s]+)\)', 1) AS h FROM tx)),
l1 AS (SELECT path, line, text, pos, regexp_replace(regexp_replace(regexp_replace(CASE WHEN contains(path, '/') THEN regexp_extract(path, '^(.*)/[^/]*$', 1) || '/' ELSE '' END || regexp_extract(token, '^([^#]*)', 1), '/\./', '/'), '[^/]+/\.\./', ''), '[^/]+/\.\./', '') AS token FROM l0 WHERE NOT starts_with(token, 'https://')),
sp AS (SELECT path, line, text, pos, regexp_replace(token, '[()]+$', '') AS token FROM (SELECT path, line, text, unnest(range(len(h))) AS pos, unnest(h) AS token FROM (SELECT *, regexp_extract_all(text, '`([A-Za-z_][A-Za-z0-9_./]*(?:\(\))?)`', 1) AS h FROM tx))),
pn AS (SELECT path, line, text, unnest(range(len(h))) AS pos, unnest(h) AS token FROM (SELECT *, regexp_extract_all(text, '\b([a-z][a-z0-9]*(?:_[a-z0-9]+)+|[A-Z][a-z0-9]+(?:[A-Z][a-z0-9]+)+)\b', 1) AS h FROM tx)),
pf AS (SELECT path, line, text, unnest(range(len(h))) AS pos, unnest(h) AS token FROM (SELECT *, regexp_extract_all(text, '\b([A-Za-z0-9_./-]+\.(?:py|js|jsx|ts|tsx|java|c|cc|cpp|h|hpp))\b', 1) AS h FROM tx)),
e AS (SELECT path, line, text, 0 AS rule, pos, 'LINKS_TO' AS type, 'doc::' || token AS target, 0.95::DOUBLE AS confidence FROM l1 WHERE token IN (SELECT path FROM md)
UNION ALL SELECT path, line, text, 0, pos, 'MENTIONS_FILE', 'file::' || token, 0.95 FROM l1 WHERE token NOT IN (SELECT path FROM md) AND token IN (FROM fl)
UNION ALL SELECT path, line, text, 1, pos, 'MENTIONS_FILE', 'file::' || token, 0.9 FROM sp WHERE token IN (FROM fl)
UNION ALL SELECT path, line, text, 1, pos * 10 + r, 'REFERENCES', id, 0.85 FROM sp JOIN ix ON name = regexp_extract(token, '([^./]*)$', 1) WHERE token NOT IN (FROM fl)
UNION ALL SELECT path, line, text, 2, pos * 10 + r, 'REFERENCES', id, 0.6 FROM pn JOIN ix ON name = token WHERE r <= 2
UNION ALL SELECT path, line, text, 3, pos, 'MENTIONS_FILE', 'file::' || token, 0.8 FROM pf WHERE token IN (FROM fl)),
de AS (SELECT path, type, target, first(line ORDER BY line, rule, pos) AS line, first(confidence ORDER BY line, rule, pos) AS confidence, left(trim(first(text ORDER BY line, rule, pos)), 200) AS evidence FROM e GROUP BY path, type, target),
dx AS (SELECT de.*, (SELECT heading FROM sec WHERE sec.path = de.path AND sec.line <= de.line ORDER BY sec.line DESC LIMIT 1) AS section FROM de)"""
)


@query(_EDGES + " SELECT path, type, target, line, confidence, evidence, section FROM dx")
def doc_edges(spark: SparkSession, d: str) -> DataFrame:
    """Links and mentions of every document, with confidence, evidence and section."""
    return K.doc_edges(docs(spark, d), symbols(spark, d))


@query(_EDGES + " SELECT path, count(*) AS n_references FROM dx GROUP BY path")
def doc_reference_counts(spark: SparkSession, d: str) -> DataFrame:
    return K.references_per_doc(K.doc_edges(docs(spark, d), symbols(spark, d)))


_NOTES = f""", src AS (SELECT k, f, camel, snake, '# ' || {_MARKER} || ': look at ' || k || CASE WHEN k % 3 = 0 THEN '' ELSE ' again' END AS note FROM pt), raw AS (SELECT k, f, camel, snake, 3 AS line, note FROM src UNION ALL SELECT k, f, camel, snake, 5, note FROM src WHERE k % 5 = 0),
nt AS (SELECT 'rationale::' || f || '::' || line AS id, {_MARKER} AS marker, regexp_extract(note, ': (.*)$', 1) AS text, f AS file, line, CASE WHEN line = 3 THEN f || '::' || camel || '.' || snake END AS node FROM raw WHERE {_MARKER} <> 'SAVE' ORDER BY f, line LIMIT 500)"""


@query(_CTE + _NOTES + " SELECT * FROM nt")
def developer_notes(spark: SparkSession, d: str) -> DataFrame:
    """Notes in source files, attached to the innermost symbol around them."""
    return K.rationale(sources(spark, d), symbols(spark, d))


@query(_CTE + _NOTES + " SELECT id, marker, text FROM nt WHERE marker = 'HACK' AND (contains(lower(text), 'again') OR contains(lower(file), 'again')) ORDER BY file, line LIMIT 20")
def search_rationale(spark: SparkSession, d: str) -> DataFrame:
    notes = K.rationale(sources(spark, d), symbols(spark, d))
    return K.search_rationale(notes, "again", "hack").select("id", "marker", "text")


_NODE = "(SELECT min(id) FROM sy WHERE kind = 'callable')"


@query(_EDGES + _NOTES + f""", nd AS (SELECT * FROM sy WHERE id = {_NODE}), refs AS (SELECT 'document' AS part, path AS other, line::INT AS line, confidence FROM dx, nd WHERE target = nd.id OR target = 'file::' || nd.file ORDER BY target = nd.id DESC, confidence DESC, path, line LIMIT 20),
rat AS (SELECT 'rationale' AS part, nt.marker AS other, nt.line::INT AS line, 1.0::DOUBLE AS confidence FROM nt, nd WHERE nt.node = nd.id LIMIT 20), cal AS (SELECT 'in' AS part, sy.name AS other, 0 AS line, 0.9::DOUBLE AS confidence FROM sy, nd WHERE sy.file = nd.file AND sy.id <> nd.id)
SELECT * FROM refs UNION ALL SELECT * FROM rat UNION ALL SELECT * FROM cal""")
def node_references(spark: SparkSession, d: str) -> DataFrame:
    """What is known about one function: documents, notes, and the call to it from its class with its provenance."""
    nodes = written(symbols(spark, d))
    documents = docs(spark, d)
    node = nodes.where("kind = 'callable'").agg(F.min("id").alias("id")).first()["id"]
    calls = nodes.where("kind = 'type'").join(nodes.where("kind = 'callable'").select(F.col("file"), F.col("id").alias("dst")), "file").select(F.col("id").alias("src"), "dst", F.lit("python_ast").alias("adapter"), F.lit(None).cast("double").alias("confidence"), F.lit("f").alias("callee"))
    known = K.node_references(node, nodes, calls, K.doc_edges(documents, nodes), K.documents(documents), K.rationale(sources(spark, d), nodes))
    out = known["referenced_in"].select(F.lit("document").alias("part"), F.col("path").alias("other"), F.col("line").cast("int").alias("line"), "confidence")
    out = out.union(known["rationale"].select(F.lit("rationale"), "marker", F.col("line").cast("int"), F.lit(1.0)))
    return out.union(known["edges"].select("direction", "other", F.lit(0), "confidence"))
