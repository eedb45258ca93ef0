"""Text, retrieval and knowledge queries over documents, pages and benchmark, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import lines as T2
from ..functions import text as T
from ..functions import vocabulary as V
from ..operators import graph as G
from ..operators import retrieval as R
from ..operators.intervals import innermost
from ..operators.search import WordIndex
from . import adapters as A
from .adapters import with_
from .registry import registry

QUERIES, SQL, query = registry(__name__)


_TOK = "[lower(x) FOR x IN regexp_extract_all(coalesce({0}, ''), '[A-Za-z][a-z0-9]*|[0-9]+') IF length(x) > 1]"
_DOCTOK = f"tok AS (SELECT doc_id, unnest(list_distinct({_TOK.format('text')})) AS t FROM documents)"
_IDF = _DOCTOK + ", df AS (SELECT t, count(*) AS df FROM tok GROUP BY t), nd AS (SELECT count(*) AS n FROM documents), idf AS (SELECT t, df, ln((n + 1.0) / (df + 1)) + 1 AS idf FROM df, nd)"
#: The registered question of the retrieval queries.
QUESTION = "How does the reader ask about the nation and the other things"


def doc_tokens(spark: SparkSession, d: str) -> DataFrame:
    return A.load(spark, d, "documents").select("doc_id", F.explode(F.array_distinct(T.tokens(F.col("text")))).alias("t"))


def idf(spark: SparkSession, d: str) -> DataFrame:
    df = doc_tokens(spark, d).groupBy("t").agg(F.count(F.lit(1)).alias("df"))
    n = A.load(spark, d, "documents").agg(F.count(F.lit(1)).alias("n"))
    return df.crossJoin(F.broadcast(n)).select("t", "df", (F.log((F.col("n") + 1.0) / (F.col("df") + 1)) + 1).alias("idf"))  # one row


@query(f"WITH {_DOCTOK} SELECT doc_id, count(*) AS n_tokens, min(t) AS first, max(t) AS last FROM tok GROUP BY doc_id")
def tokenize_identifiers(spark: SparkSession, d: str) -> DataFrame:
    return doc_tokens(spark, d).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_tokens"), F.min("t").alias("first"), F.max("t").alias("last"))


@query(f"WITH {_IDF} SELECT t, df, round(idf, 6) AS idf FROM idf")
def idf_table(spark: SparkSession, d: str) -> DataFrame:
    return idf(spark, d).select("t", "df", F.round("idf", 6).alias("idf"))


_SYN = "(VALUES " + ", ".join(f"('{k}', '{w}')" for k, v in V.SYNONYMS.items() for w in v) + ") s(key, syn)"
_WORDS = f"w AS (SELECT DISTINCT event_type AS token FROM events UNION SELECT unnest({_TOK.format('p_name || chr(32) || p_type')}) FROM part UNION SELECT unnest(['errors', 'loading', 'authenticating', 'files', 'models']))"


@query(f"WITH {_WORDS}, h AS (SELECT token, key, syn, token = key AS same, length(token) >= 5 AND (starts_with(key, token) OR starts_with(token, key)) AS near FROM w, {_SYN}) SELECT DISTINCT token, syn FROM h WHERE same OR near UNION SELECT DISTINCT token, key FROM h WHERE near")
def synonym_expand(spark: SparkSession, d: str) -> DataFrame:
    """Synonyms of every token; one of five characters or more also gets those of keys it begins or that begin it."""
    table = spark.createDataFrame([(k, w) for k, v in V.SYNONYMS.items() for w in v], "key string, syn string")
    t = A.load(spark, d, "events").select(F.col("event_type").alias("token")).union(A.load(spark, d, "part").select(F.explode(T.tokens(F.concat_ws(" ", "p_name", "p_type"))))).distinct()
    t = t.union(spark.createDataFrame([(x,) for x in ("errors", "loading", "authenticating", "files", "models")], "token string")).distinct()
    near = (F.length("token") >= 5) & (F.col("key").startswith(F.col("token")) | F.col("token").startswith(F.col("key")))
    hit = t.join(F.broadcast(table), (F.col("token") == F.col("key")) | near)  # a fixed table
    return hit.select("token", "syn").union(hit.where(near).select("token", "key")).distinct()


def _field_sql(table: str, fields: dict[str, float], key: str) -> str:
    """Scores of one question over the fields of a table."""
    asked = ", ".join(f"('{w}')" for w in R.question_words(QUESTION))
    each = " UNION ALL ".join(f"SELECT {key} AS id, unnest(list_distinct({_TOK.format(c)})) AS t, {w}::DOUBLE AS w FROM {table}" for c, w in fields.items())
    return f"q(t) AS (VALUES {asked}), hit AS (SELECT f.* FROM ({each}) f SEMI JOIN q ON q.t = f.t), df AS (SELECT t, count(DISTINCT id) AS df FROM hit GROUP BY t), idf AS (SELECT t, ln(((SELECT count(*) FROM {table}) + 1.0) / (df + 1)) + 1 AS idf FROM df), sc AS (SELECT id, sum(w * idf) AS score FROM hit JOIN idf USING (t) GROUP BY id)"


def _documents(spark: SparkSession, d: str) -> DataFrame:
    return A.load(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("name"), F.col("text").alias("summary"), F.col("lang").alias("file"), F.lit("").alias("intent"))


@query("WITH " + _field_sql("documents", {"source": 3.0, "text": 1.5, "lang": 0.5}, "doc_id") + " SELECT doc_id, round(s, 6) AS score FROM (SELECT doc_id, round(coalesce(score, 0), 9) AS s FROM documents LEFT JOIN sc ON id = doc_id) ORDER BY s DESC, doc_id DESC LIMIT 30")
def relevance_topk(spark: SparkSession, d: str) -> DataFrame:
    return R.shortlist(_documents(spark, d), QUESTION).select(F.col("id").alias("doc_id"), F.round("score", 6).alias("score"))


@query("WITH " + _field_sql("documents", {"source": 3.0, "text": 1.5, "lang": 0.5}, "doc_id") + " SELECT doc_id, round(s, 6) AS score FROM (SELECT doc_id, round(coalesce(score, 0), 9) AS s FROM documents LEFT JOIN sc ON id = doc_id) ORDER BY s DESC, doc_id DESC LIMIT 30")
def indexed_topk(spark: SparkSession, d: str) -> DataFrame:
    """As relevance_topk, from a written index of all documents' words in blocks with their largest impact."""
    index = WordIndex.build(_documents(spark, d))
    return index.shortlist(QUESTION).select(F.col("id").alias("doc_id"), F.round("score", 6).alias("score"))


_AGAIN = " + ".join(f"1.5 * contains(lower(source), '{w}')::INT + contains(lower(left(text, 80)), '{w}')::INT" for w in R.rerank_words(QUESTION))


@query(f"SELECT doc_id, score FROM (SELECT doc_id, source, ({_AGAIN})::DOUBLE AS score FROM documents) WHERE score > 0 ORDER BY score DESC, source DESC, doc_id DESC LIMIT 10")
def rerank_keyword(spark: SparkSession, d: str) -> DataFrame:
    """Candidates by words of the question within their name and the first 80 characters of their summary."""
    score = R.keyword_score(F.col("source"), F.substring("text", 1, 80), R.rerank_words(QUESTION))
    return A.load(spark, d, "documents").select("doc_id", "source", score.alias("score")).where("score > 0").orderBy(F.desc("score"), F.desc("source"), F.desc("doc_id")).limit(10).select("doc_id", "score")


@query("SELECT lang, count(*) AS n FROM documents GROUP BY lang")
def language_histogram(spark: SparkSession, d: str) -> DataFrame:
    return A.load(spark, d, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("n"))


_PATH = "regexp_extract(url, '^[a-z]+://[^/?#]*/?([^?#]*)', 1)"


def _paths(spark: SparkSession, d: str) -> DataFrame:
    return A.load(spark, d, "pages").withColumn("path", F.regexp_extract("url", "^[a-z]+://[^/?#]*/?([^?#]*)", 1))


@query(f"SELECT page_id, CASE lower(regexp_extract({_PATH}, '(\\.[A-Za-z0-9]+)$', 1)) WHEN '.html' THEN 'html' ELSE 'unknown' END AS language FROM pages")
def language_detect(spark: SparkSession, d: str) -> DataFrame:
    return _paths(spark, d).select("page_id", T.language_by_suffix(F.col("path"), {".html": "html"}).alias("language"))


#: Paths with test and document names made of page paths.
_NAMED = f"(SELECT page_id, CASE page_id % 12 WHEN 0 THEN 'tests/' WHEN 1 THEN 'docs/' WHEN 2 THEN 'adr/' WHEN 3 THEN 'rfcs/' WHEN 4 THEN 'wiki/' WHEN 5 THEN 'handbook/' ELSE '' END || {_PATH} || CASE page_id % 7 WHEN 0 THEN '/README.md' WHEN 1 THEN '/history.md' WHEN 2 THEN '/adr-12.md' WHEN 3 THEN '/test_a.py' WHEN 4 THEN '/b_test.py' WHEN 5 THEN '/Contributing.rst' ELSE '' END AS p FROM pages)"


def _named(spark: SparkSession, d: str) -> DataFrame:
    pick = lambda n, names: F.coalesce(F.get(F.array(*map(F.lit, names)), (F.col("page_id") % n).cast("int")), F.lit(""))
    return _paths(spark, d).select("page_id", F.concat(pick(12, ("tests/", "docs/", "adr/", "rfcs/", "wiki/", "handbook/")), "path", pick(7, ("/README.md", "/history.md", "/adr-12.md", "/test_a.py", "/b_test.py", "/Contributing.rst"))).alias("path"))


@query(f"SELECT page_id, starts_with(b, 'test_') OR ends_with(b, '_test.py') OR regexp_matches(p, '(^|/)(tests|test|spec|__tests__)/') AS is_test, regexp_matches(p, '(^|/)(tests?|__tests__|spec)(/|$)|(^|/)test_|_test\\.') AS in_test_flow FROM (SELECT *, regexp_extract(p, '([^/]*)$', 1) AS b FROM {_NAMED})")
def is_test_path(spark: SparkSession, d: str) -> DataFrame:
    """Both rules for test paths: that of entries and that of flows."""
    return _named(spark, d).select("page_id", T.is_test_path(F.col("path")).alias("is_test"), T.is_test_flow(F.col("path")).alias("in_test_flow"))


@query(f"SELECT page_id, CASE WHEN len(p) > 2 THEN p[1] || '/' || p[2] ELSE p[1] END AS top FROM (SELECT page_id, string_split({_PATH}, '/') AS p FROM pages)")
def top_directory(spark: SparkSession, d: str) -> DataFrame:
    return _paths(spark, d).select("page_id", T.top_directory(F.col("path")).alias("top"))


@query(f"SELECT page_id, CASE WHEN starts_with(b, 'readme') THEN 'readme' WHEN starts_with(b, 'changelog') OR starts_with(b, 'history') THEN 'changelog' WHEN starts_with(b, 'contributing') THEN 'contributing' WHEN regexp_matches(p, '(^|/)(adrs?|architecture[-_]?decisions?|decisions)(/|$)|(^|/)adr[-_]?[0-9]+') THEN 'adr' WHEN regexp_matches(p, '(^|/)rfcs?(/|$)|(^|/)rfc[-_]?[0-9]+') THEN 'rfc' WHEN regexp_matches(p, '(^|/)(wiki|wikis)(/|$)') THEN 'wiki' WHEN regexp_matches(p, '(^|/)(docs?|documentation|guides?|handbook)(/|$)') THEN 'guide' ELSE 'doc' END AS kind FROM (SELECT page_id, lower(p) AS p, regexp_extract(lower(p), '([^/]*)$', 1) AS b FROM {_NAMED})")
def classify_doc_type(spark: SparkSession, d: str) -> DataFrame:
    return _named(spark, d).select("page_id", T.doc_type(F.col("path")).alias("kind"))


@query("SELECT page_id, CASE WHEN NOT starts_with(url, 'https://') THEN 'scheme' WHEN contains(host, '@') THEN 'credentials' WHEN regexp_extract(host, '([^.]+\\.[^.]+)$', 1) NOT IN ('example.com', 'example.net', 'example.org') THEN 'host' WHEN contains(path, '..') THEN 'traversal' WHEN path IN ('', '/') THEN 'path' END AS error FROM (SELECT *, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path FROM (SELECT page_id, CASE page_id % 9 WHEN 0 THEN 'https://a@example.com/x' WHEN 1 THEN 'https://evil.test/x' WHEN 2 THEN 'https://example.org/' WHEN 3 THEN 'https://example.org/a/../b' ELSE url END AS url FROM pages))")
def url_validate(spark: SparkSession, d: str) -> DataFrame:
    bad = F.get(F.array(*map(F.lit, ("https://a@example.com/x", "https://evil.test/x", "https://example.org/", "https://example.org/a/../b"))), (F.col("page_id") % 9).cast("int"))
    return A.load(spark, d, "pages").select("page_id", T.url_error(F.coalesce(bad, F.col("url"))).alias("error"))


def _cases(column: str, rules, default: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({column}, '{pattern}') THEN '{label}'" for label, pattern in rules) + f" ELSE {default} END"


@query(f"SELECT page_id, {_cases('p', V.ROLES, 'NULL')} AS role FROM (SELECT page_id, lower(CASE page_id % 5 WHEN 0 THEN 'external::module::' WHEN 1 THEN 'models/' WHEN 2 THEN 'api/' WHEN 3 THEN 'shared/' ELSE '' END || p) AS p FROM {_NAMED})")
def role_from_path(spark: SparkSession, d: str) -> DataFrame:
    pick = F.coalesce(F.get(F.array(*map(F.lit, ("external::module::", "models/", "api/", "shared/"))), (F.col("page_id") % 5).cast("int")), F.lit(""))
    return _named(spark, d).select("page_id", T.role(F.concat(pick, "path")).alias("role"))


_LINES = with_("lines")


@query(_LINES + ", s AS (SELECT *, regexp_matches(text, 'License|Copyright|token') AS mark FROM lines) SELECT doc_id, line, last_value(CASE WHEN mark THEN line END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line ROWS UNBOUNDED PRECEDING)::INT AS section FROM s")
def section_asof(spark: SparkSession, d: str) -> DataFrame:
    by = W.partitionBy("doc_id").orderBy("line").rowsBetween(W.unboundedPreceding, 0)
    mark = F.when(F.col("text").rlike("License|Copyright|token"), F.col("line"))
    return A.doc_lines(spark, d).select("doc_id", "line", F.last(mark, True).over(by).alias("section"))


@query(_LINES + " SELECT doc_id, line, CASE WHEN contains(text, 'token') THEN 'SECRET' ELSE 'LICENSE' END AS marker, left(text, 300) AS body FROM lines WHERE regexp_matches(text, 'token|License|Copyright') AND length(trim(text)) >= 8 ORDER BY doc_id, line LIMIT 500")
def rationale_notes(spark: SparkSession, d: str) -> DataFrame:
    hit = A.doc_lines(spark, d).where(F.col("text").rlike("token|License|Copyright") & (F.length(F.trim("text")) >= 8)).orderBy("doc_id", "line").limit(500)
    return hit.select("doc_id", "line", F.when(F.contains("text", F.lit("token")), "SECRET").otherwise("LICENSE").alias("marker"), F.substring("text", 1, 300).alias("body"))


@query(_LINES + ", spans AS (SELECT doc_id, line AS a, coalesce(lead(line) OVER (PARTITION BY doc_id ORDER BY line) - 1, 2147483647) AS b FROM lines WHERE length(text) > 60), notes AS (SELECT doc_id, line FROM lines WHERE regexp_matches(text, 'License|Copyright|token')) SELECT n.doc_id, n.line, arg_min(a, b - a) AS span FROM notes n LEFT JOIN spans s ON s.doc_id = n.doc_id AND n.line BETWEEN a AND b GROUP BY n.doc_id, n.line")
def span_containment(spark: SparkSession, d: str) -> DataFrame:
    """Lines that speak of licenses or tokens, with the long line that begins the stretch around each."""
    lines = A.doc_lines(spark, d)
    by = W.partitionBy("doc_id").orderBy("line")
    spans = lines.where(F.length("text") > 60).select("doc_id", F.col("line").alias("a"), (F.lead("line").over(by) - 1).alias("b"), F.col("line").alias("span"))  # the last is open
    notes = lines.where(F.col("text").rlike("License|Copyright|token")).select("doc_id", "line")
    return innermost(notes, spans, "doc_id", "line", "a", "b", "span")


@query(with_("links") + ", k AS (SELECT *, CASE WHEN starts_with(href, '#') THEN 'anchor' WHEN contains(href, '://') THEN 'external' WHEN starts_with(href, '/') THEN 'site' ELSE 'relative' END AS kind, row_number() OVER (PARTITION BY page_id, href ORDER BY pos) AS r FROM links) SELECT page_id, pos, href, kind FROM k WHERE r = 1")
def doc_links(spark: SparkSession, d: str) -> DataFrame:
    h = F.col("href")
    kind = F.when(h.startswith("#"), "anchor").when(h.contains("://"), "external").when(h.startswith("/"), "site").otherwise("relative")
    first = A.page_links(spark, d).groupBy("page_id", "href").agg(F.min("pos").alias("pos"))
    return first.select("page_id", "pos", "href", kind.alias("kind"))


_ADAPTERS = (*V.PROVENANCE, "other")
_SOURCE = "CASE adapter " + " ".join(f"WHEN '{k}' THEN '{v[0]}'" for k, v in V.PROVENANCE.items()) + " ELSE 'regex' END"
_LEVEL = "CASE adapter " + " ".join(f"WHEN '{k}' THEN {v[1]}" for k, v in V.PROVENANCE.items()) + " ELSE 0.7 END"


@query("WITH a AS (SELECT event_id, CASE event_id % 8 " + " ".join(f"WHEN {k} THEN '{x}'" for k, x in enumerate(_ADAPTERS)) + f" END AS adapter, CASE WHEN event_id % 5 = 0 THEN 0.55 END AS resolved, event_id % 3 = 0 AS call FROM events) SELECT event_id, {_SOURCE} AS source, coalesce(resolved, CASE WHEN adapter = 'python_ast' AND call THEN 0.9 ELSE {_LEVEL} END)::DOUBLE AS confidence FROM a")
def provenance_case(spark: SparkSession, d: str) -> DataFrame:
    """Source and confidence of edges by adapter, unless their resolution has its own."""
    adapter = F.get(F.array(*map(F.lit, _ADAPTERS)), (F.col("event_id") % 8).cast("int"))
    source, confidence = T.provenance(adapter, F.when(F.col("event_id") % 5 == 0, 0.55), F.when(F.col("event_id") % 3 == 0, "f"))
    return A.load(spark, d, "events").select("event_id", source.alias("source"), confidence.alias("confidence"))


@query("SELECT event_id, CASE WHEN user_id % 3 = 0 THEN 'llm' WHEN user_id % 3 = 1 THEN 'heuristic' ELSE 'ast' END AS source FROM events")
def semantic_provenance(spark: SparkSession, d: str) -> DataFrame:
    by = F.get(F.array(F.lit("bob"), F.lit("heuristic"), F.lit("x")), (F.col("user_id") % 3).cast("int"))
    return A.load(spark, d, "events").select("event_id", T.semantic_provenance(by).alias("source"))


_DOMAIN = "greatest(" + ", ".join("({" + "'n': " + " + ".join(f"contains(w, '{k}')::INT" for k in keys) + f", 'i': {-i}, 'd': '{name}'" + "})" for i, (name, keys) in enumerate(V.DOMAINS)) + ")"


@query(f"SELECT page_id, CASE WHEN b.n > 0 THEN b.d ELSE 'general' END AS domain FROM (SELECT page_id, {_DOMAIN} AS b FROM (SELECT page_id, lower(url) AS w FROM pages))")
def domain_of_words(spark: SparkSession, d: str) -> DataFrame:
    """The domain whose keywords occur most."""
    return A.load(spark, d, "pages").select("page_id", T.domain(F.lower("url")).alias("domain"))


@query("SELECT source, count(*) AS n, CASE WHEN (SELECT count(*) FROM documents) > 0 THEN printf('%.0f%%', 100.0 * count(*) / (SELECT count(*) FROM documents)) ELSE '0%' END AS share, count(*) || CASE count(*) WHEN 1 THEN ' document' ELSE ' documents' END AS label FROM documents GROUP BY source")
def shares(spark: SparkSession, d: str) -> DataFrame:
    """Percentages and plurals of a report."""
    docs = A.load(spark, d, "documents")
    total = docs.count()
    each = docs.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    return each.select("source", "n", T.percent(F.col("n"), F.lit(total)).alias("share"), T.plural(F.col("n"), "document").alias("label"))


@query(f"WITH {_DOCTOK}, names AS (SELECT lower(source) AS name, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM documents) SELECT i.item_id, n.doc_id FROM (SELECT item_id, unnest(list_distinct({_TOK.format('text')})) AS t FROM benchmark) i JOIN (SELECT t, doc_id FROM (SELECT t, doc_id, row_number() OVER (PARTITION BY t ORDER BY doc_id) AS r FROM tok WHERE length(t) >= 4) WHERE r <= 3) n ON n.t = i.t GROUP BY ALL")
def token_symbol_links(spark: SparkSession, d: str) -> DataFrame:
    top = G.top_per(doc_tokens(spark, d).where(F.length("t") >= 4), 3, ["t"], "doc_id")
    items = A.load(spark, d, "benchmark").select("item_id", F.explode(F.array_distinct(T.tokens(F.col("text")))).alias("t"))
    return items.join(top, "t").select("item_id", "doc_id").distinct()


def _any(column: str, words) -> str:
    return "(" + " OR ".join("contains({}, '{}')".format(column, w.replace("'", "''")) for w in (words)) + ")"


_INTENT = "CASE " + " ".join(f"WHEN {_any('n', words)} THEN '{label}'" for label, words in V.INTENTS) + " ELSE 'unknown' END"
_EFFECTS = "[" + ", ".join(f"CASE WHEN {_any('c', words)} THEN '{label}' END" for label, words in V.SIDE_EFFECTS) + "]"
#: A name and a body of code made of each document.
_CODE = "(SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'load_' WHEN 1 THEN 'checkMain' WHEN 2 THEN 'on_helper_' WHEN 3 THEN 'render.' WHEN 4 THEN 'test_get' ELSE '' END || regexp_extract(text, '^([A-Za-z]*)', 1) AS name, CASE doc_id % 4 WHEN 0 THEN 'async def f(): yield db.query(1)' || chr(10) WHEN 1 THEN 'bus.emit(x)' || chr(10) WHEN 2 THEN '@on def g(): print(2)' || chr(10) ELSE '' END || text AS code FROM documents)"


def _code(spark: SparkSession, d: str) -> DataFrame:
    pick = lambda n, names: F.coalesce(F.get(F.array(*map(F.lit, names)), (F.col("doc_id") % n).cast("int")), F.lit(""))
    name = F.concat(pick(6, ("load_", "checkMain", "on_helper_", "render.", "test_get")), F.regexp_extract("text", "^([A-Za-z]*)", 1))
    code = F.concat(pick(4, ("async def f(): yield db.query(1)\n", "bus.emit(x)\n", "@on def g(): print(2)\n")), "text")
    return A.load(spark, d, "documents").select("doc_id", name.alias("name"), code.alias("code"))


@query(f"SELECT doc_id, {_INTENT} AS intent, CASE WHEN k < 20 THEN 'low' WHEN k < 50 THEN 'medium' WHEN k < 100 THEN 'high' ELSE 'very_high' END AS complexity, CASE WHEN {_any('n', V.CRITICAL_WORDS)} THEN 'high' WHEN {_any('n', V.MINOR_WORDS)} THEN 'low' ELSE 'medium' END AS criticality, coalesce(nullif(array_to_string({_EFFECTS}, ','), ''), 'none') AS side_effects, coalesce(array_to_string([CASE WHEN contains(code, 'yield ') THEN 'generator' END, CASE WHEN contains(code, 'async ') OR contains(code, 'await ') THEN 'async' END, CASE WHEN contains(code, '@') AND contains(code, 'def ') THEN 'decorator' END], ','), '') AS patterns, 0.4::DOUBLE AS confidence FROM (SELECT doc_id, lower(name) AS n, code, lower(code) AS c, len(string_split(code, chr(10))) AS k FROM {_CODE})")
def heuristic_semantics(spark: SparkSession, d: str) -> DataFrame:
    """Semantics of a function from its name and code alone."""
    code = F.col("code")
    return _code(spark, d).select(
        "doc_id", T.intent(F.col("name")).alias("intent"), T.complexity(F.size(F.split(code, "\n"))).alias("complexity"), T.criticality(F.col("name")).alias("criticality"),
        F.array_join(T.side_effects(code), ",").alias("side_effects"), F.array_join(T.code_patterns(code), ",").alias("patterns"), F.lit(0.4).alias("confidence"),
    )


_BEGINS = " OR ".join(f"starts_with(n, '{p}')" for p in V.CONSUMER_STARTS) + " OR " + " OR ".join(f"ends_with(n, '{p}')" for p in V.CONSUMER_ENDS)


@query(f"SELECT doc_id, CASE WHEN {_any('dec', V.API_DECORATORS)} OR {_any('(chr(32) || dec)', [' ' + p for p in V.API_PREFIXES])} THEN 'EXPOSES_API' WHEN {_any('c', V.DB_CODE)} THEN 'USES_DB' WHEN {_any('c', V.EMIT_CODE)} THEN 'EMITS_EVENT' WHEN {_any('dec', V.CONSUMER_DECORATORS)} OR {_BEGINS} THEN 'CONSUMES_EVENT' ELSE 'CALLS' END AS kind FROM (SELECT doc_id, lower(name) AS n, lower(code) AS c, CASE doc_id % 13 WHEN 0 THEN 'app.route' WHEN 1 THEN 'bp.x' WHEN 2 THEN 'celery' ELSE '' END AS dec FROM {_CODE})")
def semantic_kind_case(spark: SparkSession, d: str) -> DataFrame:
    """API by decorators, database and events by code, consumers by decorators and names."""
    dec = F.coalesce(F.get(F.array(*map(F.lit, ("app.route", "bp.x", "celery"))), (F.col("doc_id") % 13).cast("int")), F.lit(""))
    return _code(spark, d).select("doc_id", T.semantic_kind(F.col("name"), F.col("code"), dec).alias("kind"))


_VERB = "CASE first " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in V.VERBS.items()) + " ELSE first || CASE WHEN ends_with(first, 's') THEN '' ELSE 's' END END"


@query(f"WITH p AS (SELECT doc_id, name, list_filter(string_split(regexp_replace(regexp_replace(regexp_replace(name, '^(test_|_)', ''), '([a-z])([A-Z])', '\\1 \\2', 'g'), '[_.\\s]', ' ', 'g'), ' '), lambda x: x <> '') AS parts FROM {_CODE}), f AS (SELECT doc_id, name, parts, upper(parts[1][1]) || lower(parts[1][2:]) AS first FROM p) SELECT doc_id, CASE WHEN len(parts) = 0 THEN 'Function ' || name || '.' ELSE left({_VERB} || ' ' || coalesce(nullif(lower(array_to_string(parts[2:], ' ')), ''), 'function') || '.', 120) END AS line FROM f")
def one_liner(spark: SparkSession, d: str) -> DataFrame:
    """A sentence from a name: parts at case changes and marks, a verb for a known first part."""
    return _code(spark, d).select("doc_id", T.one_liner(F.col("name"), F.lit("function")).alias("line"))


#: A function in a brace language made of each part.
_BRACES = "(SELECT p_partkey, replace(p_name, ' ', '_') AS name, 'int ' || replace(p_name, ' ', '_') || '(int x) { // }' || chr(10) || '  if (x) { ' || split_part(p_name, ' ', 2) || '(x); }' || chr(10) || CASE WHEN p_partkey % 3 = 0 THEN '  while (x) { other.run(x);' || chr(10) || '  }' || chr(10) ELSE '' END || '  return ' || replace(p_name, ' ', '_') || '(sizeof(x));' || chr(10) || CASE WHEN p_partkey % 7 = 0 THEN '' ELSE '}' || chr(10) || 'int after;' END AS code FROM part)"


def _braces(spark: SparkSession, d: str) -> DataFrame:
    name, noun = F.replace("p_name", F.lit(" "), F.lit("_")), F.split("p_name", " ")[1]
    code = F.concat(
        F.lit("int "), name, F.lit("(int x) { // }\n  if (x) { "), noun, F.lit("(x); }\n"), F.when(F.col("p_partkey") % 3 == 0, "  while (x) { other.run(x);\n  }\n").otherwise(""),
        F.lit("  return "), name, F.lit("(sizeof(x));\n"), F.when(F.col("p_partkey") % 7 == 0, "").otherwise("}\nint after;"),
    )
    return A.load(spark, d, "part").select("p_partkey", name.alias("name"), code.alias("code"))


@query(f"WITH l AS (SELECT p_partkey, unnest(range(1, len(p) + 1)) AS line, split_part(unnest(p), '//', 1) AS text FROM (SELECT p_partkey, string_split(code, chr(10)) AS p FROM {_BRACES})), r AS (SELECT p_partkey, line, sum(length(text) - length(replace(text, '{{', '')) - length(text) + length(replace(text, '}}', ''))) OVER w AS depth, sum(contains(text, '{{')::INT) OVER w AS opened FROM l WINDOW w AS (PARTITION BY p_partkey ORDER BY line)) SELECT p_partkey, coalesce(min(line) FILTER (opened > 0 AND depth <= 0), 1)::INT AS end_line FROM r GROUP BY p_partkey")
def brace_matcher(spark: SparkSession, d: str) -> DataFrame:
    """The line on which a function's braces close, comments left out; its first line where they don't."""
    return T2.brace_ends(_braces(spark, d), "p_partkey", "code")


@query(f"SELECT p_partkey, unnest(list_distinct([x FOR x IN regexp_extract_all(code, '([A-Za-z_][$A-Za-z0-9_]*)\\s*\\(', 1) IF x NOT IN ({', '.join(repr(k) for k in sorted(V.KEYWORDS))}) AND x <> name])) AS callee FROM {_BRACES}")
def call_names(spark: SparkSession, d: str) -> DataFrame:
    """Names called in a function, without keywords and its own."""
    return _braces(spark, d).select("p_partkey", F.explode(T2.call_names(F.col("code"), F.col("name"))).alias("callee"))
