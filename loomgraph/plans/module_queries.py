"""Modules, entry points, views and the flow summary over the commerce graph as a code base, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vocabulary as V
from ..operators import modules as M
from ..storage import spread, written
from . import adapters as A
from .adapters import with_
from .registry import registry

QUERIES, SQL, query = registry(__name__)


_FOLDERS = (("automobile account", "/main.py"), ("building account", "/tests/test_b.py"), ("furniture account", "/utils.py"), ("household account", "/training/run.py"), ("machinery account", "/app.py"))


def nodes(spark: SparkSession, d: str) -> DataFrame:
    """Customers are functions in the files of their nation and segment, suppliers classes in its models."""
    n = F.substring("id", 2, 20).cast("int")
    rest = F.lit("/models.py")
    for summary, path in _FOLDERS:
        rest = F.when(F.col("summary") == summary, path).otherwise(rest)
    name = F.when(F.col("kind") == "type", F.col("name")).when(n % 7 == 0, "main").when(n % 7 == 1, "batch_main").when(n % 7 == 2, "start").otherwise(F.concat(F.lit("work_"), "id"))
    rows = A.commerce_nodes(spark, d).withColumn("nation", F.col("file")).withColumn("intent", F.when(n % 97 == 0, "orchestration").otherwise("unknown"))
    return rows.select(F.concat("file", rest, F.lit("::"), name, F.lit("#"), "id").alias("id"), F.col("id").alias("key"), name.alias("name"), "kind", "type", F.concat("file", rest).alias("file"), "summary", "criticality", "intent", F.concat_ws("#", "nation", (n % 3).cast("string")).alias("community"))


def symbols(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and membership, written once.

    Both are hinted to be merged: their files compress to so few bytes that Spark would broadcast millions of rows, and each
    of these sides goes through the driver.
    """
    plain = written(nodes(spark, d))
    n = plain.hint("merge")
    return n, written(M.membership(n, plain.select("id", "community"))).hint("merge")


def graph(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes, calls and membership, written once."""
    n, m = symbols(spark, d)
    at = n.select("key", "id")
    e = A.commerce_edges(spark, d).join(at.toDF("src", "s"), "src").join(at.toDF("dst", "t"), "dst").select(F.col("s").alias("src"), F.col("t").alias("dst"))
    return n, written(e), m


def _ends(spark: SparkSession, d: str, n: DataFrame, m: DataFrame) -> DataFrame:
    """(src, sm, pattern, dst, tm, name) of calls by their keys, a few bytes in place of ids: the modules of both ends, the
    caller's pattern and the callee's name. Flow and patterns are made of it; ends are looked up once, and it is written once.
    """
    at = n.join(m.select("id", "module"), "id").select("key", "module", _pattern("id").alias("pattern"), "name")
    at = written(at).hint("merge")
    calls = A.commerce_edges(spark, d).join(at.select(F.col("key").alias("src"), F.col("module").alias("sm"), "pattern"), "src")
    calls = spread(calls, A.load(spark, d, "lineitem").count(), "dst")
    return written(calls.join(at.select(F.col("key").alias("dst"), F.col("module").alias("tm"), "name"), "dst").select("src", "sm", "pattern", "dst", "tm", "name"))


def _modules(n: DataFrame, m: DataFrame, ends: DataFrame) -> DataFrame:
    """Modules with entry tag, pattern count and kind."""
    inside = ends.where("sm = tm").select(F.col("src").alias("id"), F.col("sm").alias("module"), F.col("dst").alias("callee"), "name").hint("merge")
    return M.modules(n, m, M.entry_functions(n, _first_main(n)), M.resolved(ends.select(F.col("src").alias("id"), "pattern", "name"), inside))


def _first_main(n: DataFrame) -> list[str]:
    return [n.where("endswith(file, 'main.py')").agg(F.min("file")).first()[0], "no.such.module"]


_CASE = "CASE " + " ".join(f"WHEN summary = '{s}' THEN '{p}'" for s, p in _FOLDERS) + " ELSE '/models.py' END"
_SH = (
    with_("cnodes", "cedges")
    + f", s0 AS (SELECT *, substr(id, 2)::INT AS num, file || {_CASE} AS path FROM cnodes), s1 AS (SELECT *, CASE WHEN kind = 'type' THEN name WHEN num % 7 = 0 THEN 'main' WHEN num % 7 = 1 THEN 'batch_main' WHEN num % 7 = 2 THEN 'start' ELSE 'work_' || id END AS nm FROM s0)"
    ", sh AS MATERIALIZED (SELECT path || '::' || nm || '#' || id AS id, id AS key, nm AS name, kind, type, path AS file, regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir, summary, criticality, CASE WHEN num % 97 = 0 THEN 'orchestration' ELSE 'unknown' END AS intent, file || '#' || (num % 3) AS community FROM s1)"
    ", ed AS MATERIALIZED (SELECT a.id AS src, b.id AS dst FROM cedges JOIN sh a ON a.key = src JOIN sh b ON b.key = dst)"
    ", hc AS (SELECT community, first(dir ORDER BY n DESC, dir) AS hint FROM (SELECT community, dir, count(*) AS n FROM sh GROUP BY ALL) GROUP BY community)"
    ", mem AS MATERIALIZED (SELECT id, 'mod_' || left(sha256(hint), 8) AS module, hint FROM sh JOIN hc USING (community))"
    ", me AS MATERIALIZED (SELECT a.module AS src, b.module AS dst, count(*) AS n FROM ed JOIN mem a ON a.id = src JOIN mem b ON b.id = dst WHERE a.module <> b.module GROUP BY ALL)"
    ", ent AS (SELECT id FROM sh WHERE (name IN ('main', 'run', 'start', 'train') OR ends_with(name, '_main')) AND file = (SELECT min(file) FROM sh WHERE ends_with(file, 'main.py')))"
    ", pg AS (SELECT DISTINCT src AS id, a.module, CASE length(src) % 4 WHEN 0 THEN 'conditional_branch' WHEN 1 THEN 'error_handling' WHEN 2 THEN 'try_block' ELSE 'loop' END AS pattern, dst AS callee FROM ed JOIN mem a ON a.id = src JOIN mem b ON b.id = dst WHERE a.module = b.module)"
    ", mo AS MATERIALIZED (SELECT module, min(hint) AS name, count(*) AS n_functions, count(DISTINCT file) AS n_files, coalesce(bool_or(ent.id IS NOT NULL), false) AS is_entry, coalesce(max(p.n), 0) AS n_patterns, CASE WHEN bool_or(ent.id IS NOT NULL) THEN 'entry' WHEN bool_or(intent = 'orchestration') THEN 'core' WHEN coalesce(max(p.n), 0) > 0 THEN 'control_flow' ELSE 'utility' END AS kind FROM mem JOIN sh USING (id) LEFT JOIN ent ON ent.id = mem.id LEFT JOIN (SELECT module, count(DISTINCT pattern) AS n FROM pg GROUP BY module) p USING (module) GROUP BY module)"
)


@query(_SH + " SELECT * FROM mem")
def module_membership(spark: SparkSession, d: str) -> DataFrame:
    """Communities of one folder merged into one module."""
    return graph(spark, d)[2]


def _pattern(c: str) -> Column:
    """The pattern that a function's calls are in, by its id."""
    return F.when(F.length(c) % 4 == 0, "conditional_branch").when(F.length(c) % 4 == 1, "error_handling").when(F.length(c) % 4 == 2, "try_block").otherwise("loop")


def _groups(n: DataFrame, e: DataFrame, m: DataFrame) -> DataFrame:
    """Call names in the control flow of each function (a pattern by its id) resolved in its module."""
    patterns = e.join(n.select(F.col("id").alias("dst"), "name"), "dst").select(F.col("src").alias("id"), _pattern("src").alias("pattern"), "name")
    return M.pattern_groups(patterns, m, n, e)


@query(_SH + " SELECT * FROM pg")
def control_flow_groups(spark: SparkSession, d: str) -> DataFrame:
    """Control-flow calls resolved to functions of the same module."""
    return _groups(*graph(spark, d))


_DESC = "CASE pattern " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in V.PATTERNS.items()) + " END"


@query(_SH + f", b AS (SELECT pattern, id FROM pg UNION SELECT pattern, callee FROM pg), c AS (SELECT pattern, count(*) AS n FROM b GROUP BY pattern HAVING count(*) >= 2) SELECT pattern, id, name, file, n, {_DESC} AS description FROM b JOIN c USING (pattern) JOIN sh USING (id)")
def pattern_submodules(spark: SparkSession, d: str) -> DataFrame:
    """The table of every control-flow pattern of two functions or more."""
    n, e, m = graph(spark, d)
    return M.pattern_table(_groups(n, e, m), n)


@query(_SH + " SELECT * FROM mo")
def module_table(spark: SparkSession, d: str) -> DataFrame:
    """Modules with entry tag, pattern count and kind."""
    n, m = symbols(spark, d)
    return _modules(n, m, _ends(spark, d, n, m))


@query(_SH + " SELECT count(*) AS total_modules, count(*) FILTER (is_entry) AS entry_point_modules, count(*) FILTER (n_patterns > 0) AS modules_with_control_flow FROM mo")
def graph_totals(spark: SparkSession, d: str) -> DataFrame:
    """Totals that go with a graph view."""
    return module_table(spark, d).agg(F.count(F.lit(1)).alias("total_modules"), F.count_if("is_entry").alias("entry_point_modules"), F.count_if(F.col("n_patterns") > 0).alias("modules_with_control_flow"))


def _both(pair: tuple[DataFrame, DataFrame]) -> DataFrame:
    """Nodes and edges of a view as rows."""
    n, e = pair
    return n.select(F.lit("node").alias("part"), "id", F.coalesce("parent", F.lit("")).alias("other"), "kind", "label").union(e.select(F.lit("edge"), "src", "dst", "kind", F.lit("")))


_TOP = "SELECT 'node' AS part, module AS id, '' AS other, 'module' AS kind, min(hint) AS label FROM mem GROUP BY module UNION ALL SELECT 'edge', src, dst, 'FLOW', '' FROM me"
_SUB = ", sb AS (SELECT mem.id, module, module || '::' || file AS sub, file, name, type FROM mem JOIN sh USING (id))"


@query(_SH + " " + _TOP)
def depth1_view(spark: SparkSession, d: str) -> DataFrame:
    """Modules and their flow."""
    n, e, m = graph(spark, d)
    return _both(M.view(n, m, e, 1))


@query(_SH + _SUB + f" {_TOP} UNION ALL SELECT DISTINCT 'node', sub, module, 'submodule', regexp_extract(file, '([^/]*)$', 1) FROM sb UNION ALL SELECT DISTINCT 'edge', module, sub, 'CONTAINS', '' FROM sb UNION ALL SELECT DISTINCT 'edge', a.sub, b.sub, 'FLOW', '' FROM ed JOIN sb a ON a.id = src JOIN sb b ON b.id = dst WHERE a.sub <> b.sub")
def depth2_view(spark: SparkSession, d: str) -> DataFrame:
    """Modules, their files, and the flow between both."""
    n, e, m = graph(spark, d)
    return _both(M.view(n, m, e, 2))


@query(_SH + _SUB + f" {_TOP} UNION ALL SELECT 'node', id, module, type, name FROM sb UNION ALL SELECT 'edge', module, id, 'CONTAINS', '' FROM sb UNION ALL SELECT 'edge', src, dst, 'CALLS', '' FROM ed")
def depth3_view(spark: SparkSession, d: str) -> DataFrame:
    """Modules, their functions, and calls."""
    n, e, m = graph(spark, d)
    return _both(M.view(n, m, e, 3))


_M1 = "(SELECT min(module) FROM mem)"


@query(_SH + _SUB + f", x AS (SELECT * FROM sb WHERE module = {_M1}), k AS (SELECT DISTINCT sub AS id, regexp_extract(file, '([^/]*)$', 1) AS label, 'submodule' AS kind FROM x UNION ALL SELECT DISTINCT module || '::cf::' || pattern, CASE pattern WHEN 'conditional_branch' THEN 'Conditional Branch' WHEN 'error_handling' THEN 'Error Handling' WHEN 'try_block' THEN 'Try Block' ELSE 'Loop' END, 'control_flow_group' FROM pg WHERE module = {_M1}) SELECT 'node' AS part, id, {_M1} AS other, kind, label FROM k UNION ALL SELECT 'edge', {_M1}, id, 'CONTAINS', '' FROM k UNION ALL SELECT DISTINCT 'edge', a.sub, b.sub, 'FLOW', '' FROM ed JOIN x a ON a.id = src JOIN x b ON b.id = dst WHERE a.sub <> b.sub")
def expand_module(spark: SparkSession, d: str) -> DataFrame:
    """A module's files, pattern groups, and the flow between its files."""
    n, e, m = graph(spark, d)
    return _both(M.expand(n, m, e, m.agg(F.min("module")).first()[0], _groups(n, e, m)))


_S1 = "(SELECT min(sub) FROM sb)"


@query(_SH + _SUB + f", x AS (SELECT * FROM sb WHERE sub = {_S1}) SELECT 'node' AS part, id, {_S1} AS other, type AS kind, name AS label FROM x UNION ALL SELECT 'edge', {_S1}, id, 'CONTAINS', '' FROM x UNION ALL SELECT 'edge', src, dst, 'CALLS', '' FROM ed WHERE src IN (SELECT id FROM x) AND dst IN (SELECT id FROM x)")
def expand_submodule(spark: SparkSession, d: str) -> DataFrame:
    """A module's file: its functions and the calls among them."""
    n, e, m = graph(spark, d)
    sub = m.join(n.select("id", "file"), "id").agg(F.min(F.concat_ws("::", "module", "file"))).first()[0]
    return _both(M.expand(n, m, e, sub))


@query(_SH + ", x AS (SELECT DISTINCT dst FROM ed WHERE src = (SELECT min(src) FROM ed)) SELECT 'node' AS part, id, (SELECT min(src) FROM ed) AS other, type AS kind, name AS label FROM sh WHERE id IN (FROM x) UNION ALL SELECT 'edge', (SELECT min(src) FROM ed), dst, 'CALLS', '' FROM x")
def expand_function(spark: SparkSession, d: str) -> DataFrame:
    """A function's callees."""
    n, e, m = graph(spark, d)
    return _both(M.expand(n, m, e, e.agg(F.min("src")).first()[0]))


_F1 = "(SELECT min(file) FROM sh WHERE kind <> 'type')"


@query(_SH + f", x AS (SELECT b.file AS tf, count(*) AS n FROM ed JOIN sh a ON a.id = src JOIN sh b ON b.id = dst WHERE a.file = {_F1} AND b.file <> a.file GROUP BY b.file ORDER BY n DESC, tf LIMIT 12) SELECT 'node' AS part, 'file::' || tf AS id, 'file::' || {_F1} AS other, 'file' AS kind, regexp_extract(tf, '([^/]*)$', 1) AS label FROM x UNION ALL SELECT 'edge', 'file::' || {_F1}, 'file::' || tf, 'FLOW', '' FROM x")
def expand_file_callees(spark: SparkSession, d: str) -> DataFrame:
    """The twelve files that a file calls most."""
    n, e, _ = graph(spark, d)
    return _both(M.expand_file(n, e, n.where("kind <> 'type'").agg(F.min("file")).first()[0]))


@query(_SH + f", g AS (SELECT id, count(*) AS n FROM (SELECT src AS id FROM ed UNION ALL SELECT dst FROM ed) GROUP BY id), x AS (SELECT sh.* FROM sh LEFT JOIN g USING (id) WHERE file = {_F1} ORDER BY coalesce(n, 0) DESC, id LIMIT 40) SELECT 'node' AS part, id, 'file::' || {_F1} AS other, type AS kind, name AS label FROM x UNION ALL SELECT 'edge', 'file::' || {_F1}, id, 'CONTAINS', '' FROM x UNION ALL SELECT 'edge', src, dst, 'CALLS', '' FROM ed WHERE src IN (SELECT id FROM x) AND dst IN (SELECT id FROM x)")
def expand_file_functions(spark: SparkSession, d: str) -> DataFrame:
    """The forty symbols of highest degree in a file."""
    n, e, _ = graph(spark, d)
    return _both(M.expand_file(n, e, n.where("kind <> 'type'").agg(F.min("file")).first()[0], "functions"))


_IN = lambda names: ", ".join(f"'{x}'" for x in names)
_BOOST = "CASE base " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in V.ENTRY_FILES.items()) + " ELSE 0 END"
_ENTRY = _SH + f""", fb AS (SELECT file, regexp_extract(file, '([^/]*)$', 1) AS base FROM sh GROUP BY file), hint AS (SELECT file, first(q ORDER BY p DESC, q) AS symbol FROM (SELECT file, regexp_replace(id, '^.*?::', '') AS q, CASE WHEN name = 'main' THEN 50 ELSE 0 END + CASE WHEN ends_with(name, '_main') THEN 35 ELSE 0 END + CASE WHEN name IN ('run', 'start', 'train') THEN 25 ELSE 0 END + CASE WHEN ends_with(file, 'main.py') THEN 10 ELSE 0 END AS p FROM sh WHERE type IN ('function', 'method')) WHERE p > 0 GROUP BY file),
ef AS (SELECT a.file AS sf, b.file AS tf FROM ed JOIN sh a ON a.id = src JOIN sh b ON b.id = dst WHERE a.file <> b.file), dg AS (SELECT file, (SELECT count(*) FROM ef WHERE sf = file) AS o, (SELECT count(*) FROM ef WHERE tf = file) AS i FROM fb),
sc AS (SELECT file, symbol, o, ({_BOOST} - CASE WHEN base IN ({_IN(V.NO_ENTRY_FILES)}) THEN 40 ELSE 0 END + CASE WHEN regexp_matches(lower(file), '(^|/)({'|'.join(V.TRAINING_DIRS)})/') THEN 20 ELSE 0 END + CASE WHEN symbol IS NOT NULL THEN 30 ELSE 0 END + CASE WHEN i = 0 THEN 2 ELSE 0 END + least(o, 6) * 0.5)::DOUBLE AS score FROM fb JOIN dg USING (file) LEFT JOIN hint USING (file) WHERE NOT (starts_with(base, 'test_') OR ends_with(base, '_test.py') OR regexp_matches(file, '(^|/)(tests|test|spec|__tests__)/')))"""


@query(_ENTRY + " SELECT file, score, symbol, 'heuristic' AS source FROM sc WHERE score > 0 AND ((SELECT max(score) FROM sc) < 60 OR score >= 60) ORDER BY sc.score DESC, file LIMIT 4")
def entry_points(spark: SparkSession, d: str) -> DataFrame:
    """The four files to begin with."""
    n, e, _ = graph(spark, d)
    return M.entry_files(n, e)


@query(_ENTRY + " SELECT file, 999.0::DOUBLE AS score, symbol, 'declared' AS source FROM fb LEFT JOIN hint USING (file) WHERE file IN (SELECT min(file) FROM sh WHERE ends_with(file, 'main.py') UNION ALL SELECT min(file) FROM sh WHERE ends_with(file, 'app.py'))")
def entry_points_declared(spark: SparkSession, d: str) -> DataFrame:
    """Declared entry points, one of which has a well-known name."""
    n, e, _ = graph(spark, d)
    app = n.where("endswith(file, 'app.py')").agg(F.min("file")).first()[0]
    return M.entry_files(n, e, [*_first_main(n), app])


_PICK = _SH + """, tst AS (SELECT module, avg(regexp_matches(file, '(^|/)(tests?|__tests__|spec)(/|$)|(^|/)test_|_test\\.')::INT) > 0.5 AS test FROM mem JOIN sh USING (id) GROUP BY module), pl AS (SELECT mo.* FROM mo JOIN tst USING (module) WHERE NOT test OR (SELECT bool_and(test) FROM tst)),
h0 AS (SELECT module, row_number() OVER (ORDER BY n_functions DESC, module) AS pos FROM (SELECT * FROM pl WHERE is_entry OR (NOT EXISTS (FROM pl WHERE is_entry) AND module = (SELECT first(module ORDER BY n_functions DESC, module) FROM pl)))),
h1 AS (SELECT pl.module, (SELECT count(*) FROM h0) + row_number() OVER (ORDER BY min(h0.pos), any_value(n_functions) DESC, pl.module) AS pos FROM me JOIN h0 ON h0.module = src JOIN pl ON pl.module = dst WHERE pl.module NOT IN (SELECT module FROM h0) GROUP BY pl.module),
h2 AS (SELECT * FROM h0 UNION ALL SELECT * FROM h1), h3 AS (SELECT pl.module, (SELECT count(*) FROM h2) + row_number() OVER (ORDER BY min(h1.pos), any_value(n_functions) DESC, pl.module) AS pos FROM me JOIN h1 ON h1.module = src JOIN pl ON pl.module = dst WHERE pl.module NOT IN (SELECT module FROM h2) GROUP BY pl.module),
h4 AS (SELECT * FROM h2 UNION ALL SELECT * FROM h3), rest AS (SELECT module, (SELECT count(*) FROM h4) + row_number() OVER (ORDER BY n_functions DESC, module) AS pos FROM pl WHERE module NOT IN (SELECT module FROM h4)), pick AS MATERIALIZED (SELECT module, pos FROM (SELECT * FROM h4 UNION ALL SELECT * FROM rest) ORDER BY pos LIMIT 18),
kf AS MATERIALIZED (SELECT module, id, name, row_number() OVER (PARTITION BY module ORDER BY CASE criticality WHEN 'critical' THEN 3 WHEN 'high' THEN 2 WHEN 'medium' THEN 1 ELSE 0 END DESC, id) AS pos FROM mem JOIN sh USING (id) QUALIFY row_number() OVER (PARTITION BY module ORDER BY CASE criticality WHEN 'critical' THEN 3 WHEN 'high' THEN 2 WHEN 'medium' THEN 1 ELSE 0 END DESC, id) <= 5),
lb AS (SELECT module, p.pos, CASE WHEN count(*) OVER (PARTITION BY mo.name) > 1 THEN mo.name || ' · ' || kf.name ELSE mo.name END AS label FROM pick p JOIN mo USING (module) LEFT JOIN kf USING (module) WHERE kf.pos = 1)"""


def _flow(spark: SparkSession, d: str):
    n, m = symbols(spark, d)
    ends = _ends(spark, d, n, m)
    mods = written(_modules(n, m, ends))
    flows = written(M.module_flow(ends))
    keys = written(M.key_functions(n, m))
    return mods, flows, keys, M.labels(M.significant(mods, flows, n, m), mods, keys)


@query(_PICK + " SELECT module, pos::INT AS pos, label FROM lb")
def significant_modules(spark: SparkSession, d: str) -> DataFrame:
    """Eighteen modules in the order of a search from the entries, with labels."""
    return _flow(spark, d)[3]


@query(_PICK + ", l AS (SELECT '0' AS o, 'flowchart TD' AS line UNION ALL SELECT '3', '    classDef entry fill:#10b981,color:#fff,stroke:#059669' UNION ALL SELECT '1' || lpad(pos::VARCHAR, 8, '0'), '    ' || left(module, 40) || '[\"' || label || '\"]' || CASE WHEN is_entry THEN ':::entry' ELSE '' END FROM lb JOIN mo USING (module) UNION ALL SELECT '2' || src || '>' || dst, '    ' || src || ' --> ' || dst FROM me WHERE src IN (SELECT module FROM pick) AND dst IN (SELECT module FROM pick)) SELECT row_number() OVER (ORDER BY o)::INT AS pos, line FROM l")
def flow_mermaid(spark: SparkSession, d: str) -> DataFrame:
    """A Mermaid chart of the significant modules."""
    mods, flows, _, named = _flow(spark, d)
    return M.mermaid(named, mods, flows)


@query(_PICK + " SELECT pos::INT AS step, label AS module, mo.name || ': ' || n_functions || CASE n_functions WHEN 1 THEN ' function' ELSE ' functions' END AS description, (SELECT string_agg(name, ',' ORDER BY pos) FROM kf WHERE kf.module = lb.module) AS key_functions FROM lb JOIN mo USING (module)")
def flow_summary(spark: SparkSession, d: str) -> DataFrame:
    """Steps of the flow summary with key functions."""
    mods, _, keys, named = _flow(spark, d)
    return M.flow_steps(named, mods, keys)
