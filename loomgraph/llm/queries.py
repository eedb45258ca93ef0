"""The registered training-data queries and their SQL, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, filter_audit, langid, licenses, line_dedup, media, mixing, ngram_join, secrets_scan, source_audit, token_codes, token_counts, urlfilter
from .common import table


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_mpeg_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = media.features(media.store(table(spark, sf_dir, "documents")))
    return found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "n_frames", "duration_ns", "seek_offsets")


def tokenizer_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def op4_token_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_codes.read_codes(token_codes.write_codes(table(spark, sf_dir, "documents"), tokenizer_path()))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.suffix_sums(token_counts.histogram(table(spark, sf_dir, "documents"), tokenizer_path()))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets_scan.secrets(table(spark, sf_dir, "documents"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.fit(docs))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.licenses(table(spark, sf_dir, "documents"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(table(spark, sf_dir, "pages"), urlfilter.rule_table(spark, urlfilter.RULES))


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(table(spark, sf_dir, "documents"))


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.deduplicate(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(filter_audit.cells(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


def op13_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_audit.divergence(table(spark, sf_dir, "documents"))


_ALL = (op1_decontaminate, op2_token_counts, op3_mpeg_audio, op4_token_codes, op5_secret_scan, op6_language_id, op7_license_scan, op8_mixing, op9_url_filter, op10_ngram_jaccard, op11_line_dedup, op12_filter_audit, op13_source_audit)
QUERIES = {f.__name__: f for f in _ALL}

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = "regexp_extract_all(" + _LOWER.format("coalesce(text, '')") + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

SQL = {
    "op1_decontaminate": f"""
WITH item AS (SELECT coalesce(item_id::VARCHAR, '') AS item, {_WORDS} AS w FROM benchmark),
win AS (SELECT DISTINCT item, n, w[i:i + n - 1] AS g FROM (
  SELECT item, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM item WHERE len(w) > 0)),
doc AS (SELECT doc_id, {_WORDS} AS w FROM documents),
hit AS (SELECT doc_id, d.i, d.n, item FROM (
  SELECT doc_id, n, w[i:i + n - 1] AS g, i FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM doc, (SELECT DISTINCT n FROM win))) d
  JOIN win ON win.n = d.n AND win.g = d.g),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
SELECT doc.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM doc LEFT JOIN covered ON covered.doc_id = doc.doc_id LEFT JOIN items ON items.doc_id = doc.doc_id""",
    "op8_mixing": """
WITH size AS (SELECT source, sum(greatest(coalesce(length(text), 0), 1))::DOUBLE AS s FROM documents GROUP BY source),
rate AS (SELECT source, (SELECT sum(s) FROM size) / (SELECT count(*) FROM size) / s AS r FROM size),
term AS (SELECT source, k, exp(-r + k * ln(r) - lgamma(k + 1)) AS p FROM (SELECT source, r, unnest(range(0, ceil(r + 12 * sqrt(r) + 30)::BIGINT + 1)) AS k FROM rate)),
cdf AS (SELECT source, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS c FROM term),
u AS (SELECT *, ('0x' || substr(md5('mix-1:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u FROM documents),
n AS (SELECT doc_id, count(*) AS n FROM u JOIN cdf ON u.source IS NOT DISTINCT FROM cdf.source AND c <= u GROUP BY doc_id)
SELECT d.doc_id, text, lang, source, n_chars, n AS n_copies, copy::BIGINT AS copy, md5('mix-1:' || d.doc_id || ':' || copy) AS mix_key
FROM documents d JOIN (SELECT doc_id, n, unnest(range(1, n + 1)) AS copy FROM n) c ON c.doc_id = d.doc_id""",
    "op9_url_filter": """
WITH p AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages)),
r(verdict, h, pre) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
m AS (SELECT page_id, arg_max(h || pre, length(h || pre)) AS rule, arg_max(verdict, length(h || pre)) AS verdict
  FROM p JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, pre) GROUP BY page_id)
SELECT p.page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM p LEFT JOIN m ON m.page_id = p.page_id""",
    "op11_line_dedup": f"""
WITH line AS (SELECT r, doc_id, unnest(range(len(l))) AS i, unnest(l) AS line FROM (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)),
k AS (SELECT *, {_LOWER.format("trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")} AS key FROM line),
g AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT r) >= 3),
x AS (SELECT r, doc_id, i, line, g.key IS NOT NULL AND last IS DISTINCT FROM doc_id AS gone FROM k LEFT JOIN g ON g.key = k.key)
SELECT any_value(doc_id) AS doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM x GROUP BY r""",
    "op12_filter_audit": r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
f AS (SELECT doc_id, part, (len(w) < 200)::INT + 2 * (100 * len(list_distinct(w)) < 50 * len(w))::INT + 4 * (100 * len(regexp_extract_all(t, '[A-Z]')) > 3 * length(t))::INT
  + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)::INT AS m FROM d),
l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
c AS (SELECT part, m, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic FROM f LEFT JOIN l ON l.doc_id = f.doc_id GROUP BY part, m),
a(x) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM a, a b, a c, a d, a e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s AS (SELECT filter_order, step, substr(filter_order, step, 1) AS x, 1 << (ascii(substr(filter_order, step, 1)) - 65) AS bit,
  list_sum([0] || [1 << (ascii(y) - 65) FOR y IN string_split(substr(filter_order, 1, step - 1), '') IF y <> ''])::INT AS pre FROM (SELECT filter_order, unnest(range(1, 6))::INT AS step FROM o)),
r AS (SELECT part, filter_order, step, x, sum(CASE WHEN m & (pre | bit) = 0 THEN n ELSE 0 END)::BIGINT AS kept, sum(CASE WHEN m & pre = 0 AND m & bit <> 0 THEN n ELSE 0 END)::BIGINT AS removed,
  sum(CASE WHEN m & pre <> 0 AND m & bit <> 0 THEN n ELSE 0 END)::BIGINT AS redundant, sum(CASE WHEN m = bit THEN n ELSE 0 END)::BIGINT AS unique_fails,
  sum(CASE WHEN m & pre = 0 AND m & bit <> 0 THEN good ELSE 0 END)::BIGINT AS good_lost, sum(CASE WHEN m & pre = 0 AND m & bit <> 0 THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
  FROM c, s GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, x))::BIGINT AS shapley FROM r""",
    "op13_source_audit": f"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x60\x7B-\x7F]+') AS w FROM documents),
t AS (SELECT r, lang, source, unnest(w) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS n FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= 3),
c AS (SELECT t.lang, source, term, count(*) AS n FROM t SEMI JOIN kept ON kept.lang = t.lang AND kept.term = t.term GROUP BY ALL),
v AS (SELECT lang, count(*) AS v, sum(n) AS whole FROM kept GROUP BY lang),
g AS (SELECT lang, source, coalesce((SELECT sum(n) FROM c WHERE c.lang = x.lang AND c.source = x.source), 0) AS size FROM (SELECT DISTINCT lang, source FROM d) x),
p AS (SELECT g.lang, g.source, kept.term, coalesce(c.n, 0) AS n, 1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 1) // (size + v)::HUGEINT AS p, 1 + 1000000000::HUGEINT * (kept.n + 1) // (whole + v)::HUGEINT AS q
  FROM g JOIN v ON v.lang = g.lang JOIN kept ON kept.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term),
two AS (SELECT a.lang, a.source, b.source AS item, coalesce((SELECT sum((x.p - y.p) * (x.p - y.p) // y.p) FROM p x JOIN p y ON y.lang = x.lang AND y.term = x.term
  WHERE x.lang = a.lang AND x.source = a.source AND y.source = b.source), 0)::BIGINT AS value FROM g a JOIN g b ON b.lang = a.lang AND b.source <> a.source),
more AS (SELECT lang, source, term AS item, ((p - q) * (p - q) // q)::BIGINT AS value FROM p WHERE n > 0 AND p > q),
ranked AS (SELECT *, 'pair' AS part FROM two UNION ALL SELECT *, 'term' FROM more)
SELECT * FROM (SELECT lang, source, part, item, value, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM ranked) WHERE part = 'pair' OR rank <= 200""",
}
