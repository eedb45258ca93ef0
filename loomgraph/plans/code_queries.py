"""Extraction, resolution, enrichment and the store, on source files of the parts and on the commerce graph, with their SQL."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import enrich as E
from ..operators import graph as G
from ..operators import modules as M
from ..operators import resolve as R
from ..sources import extract as X
from ..sources import repo as P
from ..sources import store as S
from ..storage import dealt, shared_dir, written
from . import adapters as A
from .adapters import with_
from .graph_queries import CO, EV, _bfs_sql, queue_sql
from .graph_queries import _seeds as _event_seeds
from .registry import registry

QUERIES, SQL, query = registry(__name__)


#: A source file for each part, in the language that its key's remainder by ten stands for: path and text, of the part's key,
#: the key five on (the next file of the language) and their folders.
PYTHON = """import pkg{nd}.m{n} as tool
from shop import ledger


class Store{k}(Store{n}):
    def __init__(self, owner: str):
        self.till = Till{n}()
        self.owner = owner

    def total_{k}(self):
        if self.owner:
            self.check_{k}()
        for x in self.lines:
            tool.load_{n}(x)
        return self.till.ring_{n}()

    def check_{k}(self):
        try:
            audit_{k}()
        except ValueError:
            ledger.note_{k}()


class Till{k}:
    def ring_{k}(self) -> int:
        return load_{n}(1)


@app.route('/{k}')
def audit_{k}(x):
    \"\"\"Audits {name}. And more.\"\"\"
    plugin = __import__('csv')
    return load_{k}(x)


def load_{k}(x):
    return db.execute(x)
"""
SCRIPT = """import {{ sum }} from './c{n}'
export class Cart{k} extends Cart{n} {{
  add_{k}(x) {{
    return help_{k}(x)
  }}
}}
export const help_{k} = (x: number): number => {{
  if (x) {{ return sum(x) }} // }}
  return 0
}}
"""
JAVA = """import shop.P{k};
public class Basket{k} extends Basket{n} {{
  public int size_{k}() {{
    return count_{k}(1);
  }}
}}
"""
PLAIN_C = """#include "r{k}.h"
int rate_{k}(int x) {{
  return x;
}}
int main_{k}(void) {{
  return rate_{k}(1);
}}
"""
CPP = """class Shape{k} {{
}};
double Shape{k}::area_{k}(int x) {{
  return measure_{k}(x);
}}
double measure_{k}(int x) {{
  return x;
}}
"""
#: Remainders by ten, path and text.
TEMPLATES = (((0, 1, 5, 6), "pkg{d}/m{k}.py", PYTHON), ((2, 7), "web/c{k}.ts", SCRIPT), ((3, 8), "src/B{k}.java", JAVA), ((4,), "lib/t{k}.c", PLAIN_C), ((9,), "lib/s{k}.cpp", CPP))


def _part(template: str, like: dict[str, Column]) -> Column:
    """A template's text with Columns in its places."""
    parts = []
    for text, field, _, _ in string.Formatter().parse(template):
        parts += [F.lit(text)] if text else []
        parts += [like[field]] if field else []
    return F.concat(*parts)


def files(spark: SparkSession, d: str) -> DataFrame:
    """(k, path, text) of a source file for each part, made in all tasks: a part is a few bytes, its file takes a millisecond to parse."""
    k, n = F.col("p_partkey"), F.col("p_partkey") + 5
    like = {"k": k.cast("string"), "n": n.cast("string"), "d": (k % 20).cast("string"), "nd": (n % 20).cast("string"), "name": F.col("p_name")}
    path = text = None
    for rest, where, body in TEMPLATES:
        mine = (k % 10).isin(*rest)
        path = F.when(mine, _part(where, like)) if path is None else path.when(mine, _part(where, like))
        text = F.when(mine, _part(body, like)) if text is None else text.when(mine, _part(body, like))
    return dealt(A.load(spark, d, "part").select("p_partkey", "p_name"), "p_partkey").select(k.alias("k"), path.alias("path"), text.alias("text"))


def changed_files(spark: SparkSession, d: str) -> DataFrame:
    """The files of keys divisible by ten after an edit: ``load`` has another name, and a function that another file asks for is new."""
    old, new = F.concat(F.lit("def load_"), "k", F.lit("(")), F.concat(F.lit("def fetch_"), "k", F.lit("("))
    more = F.concat(F.lit("\n\ndef note_"), F.col("k") + 5, F.lit("():\n    return 1\n"))
    return files(spark, d).where("k % 10 = 0").select("k", "path", F.concat(F.replace("text", old, new), more).alias("text"))


#: The same in SQL: py, ts, java, c and cpp with k, path, the next key n and its path where there is such a part.
_CODE = "WITH " + ", ".join(
    f"{lang} AS (SELECT p_partkey AS k, p_partkey + 5 AS n, p_name AS name, {path.format(k='p_partkey', d='p_partkey % 20')} AS path, {path.format(k='(p_partkey + 5)', d='(p_partkey + 5) % 20')} AS npath, p_partkey + 5 IN (SELECT p_partkey FROM part) AS has FROM part WHERE p_partkey % 10 IN ({rest}))"
    for lang, rest, path in (("py", "0, 1, 5, 6", "'pkg' || {d} || '/m' || {k} || '.py'"), ("ts", "2, 7", "'web/c' || {k} || '.ts'"), ("java", "3, 8", "'src/B' || {k} || '.java'"), ("c", "4", "'lib/t' || {k} || '.c'"), ("cpp", "9", "'lib/s' || {k} || '.cpp'"))
)


def _rows_sql(table: str, rows: list[tuple], names: str) -> str:
    """Rows made of each row of a table by SQL expressions."""
    return " UNION ALL ".join(f"SELECT {', '.join(f'{x} AS {n}' for x, n in zip(r, names.split(', ')))} FROM {table}" for r in rows)


def _symbols_sql() -> str:
    text = lambda v: "NULL::VARCHAR" if v is None else f"'{v}'"
    plan = {
        "py": [("Store' || k || '", "type", "class", 5, 21, None, None), ("Store' || k || '.__init__", "function", "method", 6, 8, "explicit", "CALLS"), ("Store' || k || '.total_' || k || '", "function", "method", 10, 15, "dynamic", "CALLS"), ("Store' || k || '.check_' || k || '", "function", "method", 17, 21, "dynamic", "CALLS"),
               ("Till' || k || '", "type", "class", 24, 26, None, None), ("Till' || k || '.ring_' || k || '", "function", "method", 25, 26, "explicit", "CALLS"), ("audit_' || k || '", "function", "function", 30, 33, "dynamic", "EXPOSES_API"), ("load_' || k || '", "function", "function", 36, 37, "dynamic", "USES_DB")],
        "ts": [("Cart' || k || '", "type", "class", 2, 6, None, None), ("Cart' || k || '.add_' || k || '", "function", "method", 3, 5, "explicit", "CALLS"), ("help_' || k || '", "function", "function", 7, 10, "explicit", "CALLS")],
        "java": [("Basket' || k || '", "type", "class", 2, 6, None, None), ("Basket' || k || '.size_' || k || '", "function", "method", 3, 5, "explicit", "CALLS")],
        "c": [("rate_' || k || '", "function", "function", 2, 4, "explicit", None), ("main_' || k || '", "function", "function", 5, 7, "explicit", None)],
        "cpp": [("Shape' || k || '", "type", "class", 1, 2, None, None), ("Shape' || k || '::area_' || k || '", "function", "method", 3, 5, "explicit", None), ("measure_' || k || '", "function", "function", 6, 8, "explicit", None)],
    }
    out = []
    for table, rows in plan.items():
        made = [(f"path || '::{i}'", text(kind), text(type_), f"{a}::INT", f"{b}::INT", text(system), text(means)) for i, kind, type_, a, b, system, means in rows]
        made.append(("path || '::<file>'", "'file'", "'file'", "1::INT", "NULL::INT", "NULL::VARCHAR", "NULL::VARCHAR"))
        out.append(_rows_sql(table, made, "id, kind, type, line, end_line, type_system, semantic_kind"))
    return _CODE + " " + " UNION ALL ".join(out)


@query(_symbols_sql())
def code_symbols(spark: SparkSession, d: str) -> DataFrame:
    """Symbols of a file for each part, in five languages."""
    return X.extract(files(spark, d), "node").select("id", "kind", "type", "line", "end_line", "type_system", "semantic_kind")


_S, _T = "path || '::Store' || k || '.", "path || '::Till' || k || '."
_CALLS = _CODE + ", calls(src, dst, confidence) AS (" + " UNION ALL ".join([
    _rows_sql("py", [(f"{_S}total_' || k", f"{_S}check_' || k", "0.95"), (f"{_S}check_' || k", "path || '::audit_' || k", "0.80"), ("path || '::audit_' || k", "path || '::load_' || k", "0.80")], "src, dst, confidence"),
    _rows_sql("(FROM py WHERE has)", [(f"{_S}total_' || k", "npath || '::load_' || n", "0.90"), (f"{_S}total_' || k", "npath || '::Till' || n || '.ring_' || n", "0.90"), (f"{_T}ring_' || k", "npath || '::load_' || n", "0.65")], "src, dst, confidence"),
    _rows_sql("ts", [("path || '::Cart' || k || '.add_' || k", "path || '::help_' || k", "0.65")], "src, dst, confidence"), _rows_sql("c", [("path || '::main_' || k", "path || '::rate_' || k", "0.65")], "src, dst, confidence"),
    _rows_sql("cpp", [("path || '::Shape' || k || '::area_' || k", "path || '::measure_' || k", "0.65")], "src, dst, confidence"),
]) + ")"


#: Columns of extracted rows that resolution doesn't read; the texts of functions are most of the bytes.
_UNASKED = ("code", "signature", "returns", "decorators", "bases", "semantic_kind", "type_system", "is_async", "end_line", "language")


@query(_CALLS + " SELECT src, dst, confidence::DOUBLE AS confidence FROM calls")
def code_calls_resolved(spark: SparkSession, d: str) -> DataFrame:
    """Calls by the tiers, at most one target each."""
    rows = X.extract(files(spark, d), "node", "edge", "attr", "import")
    return R.graph_of(rows.drop(*_UNASKED))[1].where("relationship = 'INVOKES'").select("src", "dst", "confidence")


def _asked(rows: DataFrame) -> DataFrame:
    return rows.where("row = 'edge' and relation = 'INVOKES'").select("id", "target", "receiver", "owner", "path", "adapter", "line")


@query(_CALLS + ", gone AS (SELECT path || '::load_' || k AS id FROM py WHERE k % 10 = 0), found AS (SELECT npath || '::Store' || n || '.check_' || n AS src, path || '::note_' || n AS dst, 0.55 AS confidence FROM py WHERE has AND k % 10 = 0) SELECT src, dst, confidence::DOUBLE AS confidence FROM (SELECT * FROM calls WHERE dst NOT IN (FROM gone) UNION ALL FROM found)")
def code_calls_after_update(spark: SparkSession, d: str) -> DataFrame:
    """Calls after a tenth of the files changed: lost and gained candidates are seen by callers in files that didn't change."""
    read = lambda f: written(X.extract(f(spark, d), "node", "edge", "attr", "import").drop(*_UNASKED))
    rows, new = read(files), read(changed_files)
    parts = lambda r: (_asked(r), r.where("row = 'node'"), r.where("row = 'attr'"), r.where("row = 'import'"))
    asked, nodes, attrs, imports = parts(rows)
    fresh, more, new_attrs, new_imports = parts(new)
    changed = changed_files(spark, d).select("path")
    now = lambda old, got: old.join(changed, "path", "left_anti").unionByName(got)
    edges = written(R.resolve_calls(asked, nodes, attrs, imports))
    _, edges, _ = R.update_calls(R.name_index(asked), edges, nodes, fresh, more, changed, now(attrs, new_attrs), now(imports, new_imports))
    return edges.select(F.col("id").alias("src"), F.col("target_id").alias("dst"), "confidence").distinct()


@query(_CODE + " " + " UNION ALL ".join([
    _rows_sql("py", [("path || '::<file>'", "'tool'", "'pkg' || n % 20 || '.m' || n", "'static_import'"), ("path || '::<file>'", "'ledger'", "'shop.ledger'", "'static_import'"), ("path || '::audit_' || k", "'csv'", "'csv'", "'dynamic_import'")], "id, name, target, kind"),
    _rows_sql("ts", [("path || '::<file>'", "'./c' || n", "'./c' || n", "'static_import'")], "id, name, target, kind"), _rows_sql("java", [("path || '::<file>'", "'shop.P' || k", "'shop.P' || k", "'static_import'")], "id, name, target, kind"),
    _rows_sql("c", [("path || '::<file>'", "'r' || k || '.h'", "'r' || k || '.h'", "'include'")], "id, name, target, kind"),
]))
def code_imports(spark: SparkSession, d: str) -> DataFrame:
    """Local names of imports, dynamic ones included."""
    return X.extract(files(spark, d), "import").select("id", "name", "target", F.col("receiver").alias("kind"))


@query(_CODE + " SELECT path, 'Store' || k AS owner, 'till' AS name, 'Till' || n AS type FROM py")
def code_attribute_types(spark: SparkSession, d: str) -> DataFrame:
    """Types of attributes that constructors assign."""
    return X.extract(files(spark, d), "attr").select("path", "owner", "name", F.col("target").alias("type"))


@query(_CODE + " " + _rows_sql("py", [(f"{_S}total_' || k", "'conditional_branch'", "'check_' || k"), (f"{_S}total_' || k", "'loop'", "'load_' || n"), (f"{_S}check_' || k", "'try_block'", "'audit_' || k"), (f"{_S}check_' || k", "'error_handling'", "'note_' || k")], "id, pattern, name"))
def code_control_flow(spark: SparkSession, d: str) -> DataFrame:
    """Functions called in branches, loops, try blocks and handlers."""
    return X.extract(files(spark, d), "pattern").select("id", F.col("target").alias("pattern"), "name")


@query(_CODE + " " + " UNION ALL ".join(f"SELECT path || '::{name}' || k AS id, npath || '::{name}' || n AS target_id FROM {lang} WHERE has" for lang, name in (("py", "Store"), ("ts", "Cart"), ("java", "Basket"))))
def code_inheritance(spark: SparkSession, d: str) -> DataFrame:
    """Base classes by the one class of their name."""
    rows = written(X.extract(files(spark, d), "node", "edge").where("kind = 'type' or relation = 'EXTENDS'").drop(*_UNASKED))
    return R.resolve_bases(rows.where("row = 'edge'"), rows.where("row = 'node'"))


@query(_CODE + " SELECT path AS sf, npath AS tf FROM py WHERE has")
def code_file_imports(spark: SparkSession, d: str) -> DataFrame:
    """Files of the repository that import another."""
    rows = X.extract(files(spark, d), "node", "import").where("row = 'import' or kind = 'file'")
    return R.file_imports(written(rows.select("row", "kind", "path", "target")))


@query(_CODE + " " + " UNION ALL ".join([
    _rows_sql("py", [(f"{_S}__init__'", "'Initializes function (using Till' || n || ').'"), (f"{_S}total_' || k", "'Totals ' || k || ' (using ring_' || n || ', check_' || k || ', load_' || n || ').'"), (f"{_S}check_' || k", "'Checks ' || k || ' (using audit_' || k || ', note_' || k || ').'"),
                     (f"{_T}ring_' || k", "'Rings ' || k || ' (returns int; using load_' || n || ').'"), ("path || '::audit_' || k", "'Audits ' || name || '.'"), ("path || '::load_' || k", "'Loads ' || k || ' (using execute).'")], "id, summary"),
    _rows_sql("ts", [("path || '::Cart' || k || '.add_' || k", "'Adds ' || k || '.'"), ("path || '::help_' || k", "'Helps ' || k || '.'")], "id, summary"), _rows_sql("java", [("path || '::Basket' || k || '.size_' || k", "'Sizes ' || k || '.'")], "id, summary"),
    _rows_sql("c", [("path || '::rate_' || k", "'Rates ' || k || '.'"), ("path || '::main_' || k", "'Mains ' || k || '.'")], "id, summary"),
    _rows_sql("cpp", [("path || '::Shape' || k || '::area_' || k", "'Areas ' || k || '.'"), ("path || '::measure_' || k", "'Measures ' || k || '.'")], "id, summary"),
]))
def code_descriptions(spark: SparkSession, d: str) -> DataFrame:
    """One line of each function, in all five languages: from its docstring, else from its name and what its code shows."""
    nodes = X.extract(files(spark, d), "node").drop("semantic_kind").withColumns({"summary": F.lit(None).cast("string"), "summary_source": F.lit(None).cast("string")})
    return E.enrich(nodes).select("id", "summary")


@query(_CODE + ", x AS (SELECT min(k) AS k FROM py) SELECT 'web_api' AS project_type, 'web_development' AS domain, 'modular_pipeline' AS architecture, 'Python,FastAPI,Pydantic' AS tech_stack, 'Counts ' || (SELECT count(*) FROM part) || ' parts through an api server.' AS purpose, 'pkg' || k % 20 || '.m' || k AS entries FROM x")
def repository_profile(spark: SparkSession, d: str) -> DataFrame:
    """Profile of the code base by its file names, manifests and README."""
    code = files(spark, d)
    first = F.min(F.when(F.col("path").endswith(".py"), F.col("k")))
    readme = F.concat(F.lit("# Shop\n\nCounts "), F.count(F.lit(1)), F.lit(" parts through an api server.\nRun `python -m pkg"), first % 20, F.lit(".m"), first, F.lit("` or python3 -m shop.missing.\n"))
    about = code.agg(readme.alias("text")).select(F.lit("README.md").alias("path"), "text")
    needs = code.agg(F.lit("fastapi\npydantic\n").alias("text")).select(F.lit("requirements.txt").alias("path"), "text")
    p = P.profile(code.select("path", "text").union(about).union(needs))
    return spark.createDataFrame([(p["project_type"], p["domain"], p["architecture"], ",".join(p["tech_stack"]), p["purpose"], ",".join(p["key_entry_points"]))], "project_type string, domain string, architecture string, tech_stack string, purpose string, entries string")


@query(_CODE + " SELECT path, 'changed' AS change FROM py WHERE k % 10 = 0 UNION ALL SELECT path, 'removed' FROM c UNION ALL SELECT 'new/' || path, 'added' FROM ts WHERE k % 10 = 7")
def changed_source_files(spark: SparkSession, d: str) -> DataFrame:
    """Supported files that differ between two snapshots of the code base."""
    old, new = files(spark, d).select("path", "text"), changed_files(spark, d).select("path", "text")
    now = old.join(new, "path", "left_anti").where("path not like '%.c'").union(new)
    now = now.union(files(spark, d).where("k % 10 = 7").select(F.concat(F.lit("new/"), "path"), "text")).union(spark.createDataFrame([("README.md", "new")], "path string, text string"))
    return P.changed_files(P.manifest(old), P.manifest(now))


# --- the store, on the commerce graph


def _stored(spark: SparkSession, d: str) -> tuple[S.Store, DataFrame]:
    store = S.Store(spark, shared_dir(spark))
    nodes = A.commerce_nodes(spark, d).withColumn("code", F.concat_ws(" ", "name", "summary"))
    return store, nodes


@query(CO + " SELECT id, name, kind, file, summary FROM cnodes")
def store_load_light(spark: SparkSession, d: str) -> DataFrame:
    """A graph saved, replaced, and read without code."""
    store, nodes = _stored(spark, d)
    store.save(S.Graph("g1", "/repo", {"nodes": nodes.limit(3)}))
    store.save(S.Graph("g1", "/repo", {"nodes": nodes}))
    return store.load_light("g1").tables["nodes"].select("id", "name", "kind", "file", "summary")


@query(CO + " SELECT src, dst, 'CALLS' AS type, 'INVOKES' AS relationship FROM cedges")
def store_old_edges(spark: SparkSession, d: str) -> DataFrame:
    """Edges of an older file, whose relationship follows from their type."""
    store, nodes = _stored(spark, d)
    store.save(S.Graph("g1", "/repo", {"nodes": nodes, "edges": A.commerce_edges(spark, d).withColumn("type", F.lit("CALLS"))}))
    return store.load("g1").tables["edges"].select("src", "dst", "type", "relationship")


@query("SELECT r_name AS graph_id, CASE r_regionkey WHEN 1 THEN '/moved' ELSE '/' || r_name END AS repo_path, CASE r_regionkey % 2 WHEN 0 THEN 'ann' ELSE 'bob' END AS owner FROM region WHERE r_regionkey <> 3")
def store_headers(spark: SparkSession, d: str) -> DataFrame:
    """Headers of a graph for each region after saves, a change of path and owners, and a deletion; an owner stays when saved again."""
    store, nodes = _stored(spark, d)
    regions = A.load(spark, d, "region").select("r_regionkey", "r_name").orderBy("r_regionkey").collect()  # five rows
    for k, name in regions:
        store.save(S.Graph(name, f"/{name}", {"nodes": nodes.where(F.col("module") == name)}), "ann" if k % 2 == 0 else None)
    store.save(S.Graph(regions[0][1], f"/{regions[0][1]}", {"nodes": nodes.where(F.col("module") == regions[0][1])}))
    for k, name in regions:
        if k % 2:
            store.set_owner(name, "bob")
        if k == 1:
            store.set_repo_path(name, "/moved")
        if k == 3:
            store.delete(name)
    store.vacuum()
    return store.list().select("graph_id", "repo_path", "owner")


@query("SELECT n_name AS key, CASE WHEN n_regionkey = 1 THEN 'second ' ELSE 'first ' END || n_nationkey AS value FROM nation")
def store_metadata(spark: SparkSession, d: str) -> DataFrame:
    """A value for each nation, replaced for one region's."""
    store, _ = _stored(spark, d)
    nations = A.load(spark, d, "nation")
    for word, rows in (("first ", nations), ("second ", nations.where("n_regionkey = 1"))):
        store.store_meta("g1", rows.select(F.col("n_name").alias("key"), F.concat(F.lit(word), "n_nationkey").alias("value")))
    return store.metadata("g1")


@query("SELECT prompt, CASE WHEN starts_with(prompt, 'error') THEN 'kept ' ELSE '(stub) ' END || prompt AS answer, 0 AS n_cached FROM (SELECT DISTINCT event_type || ':' || json_extract_string(props, '$.k') AS prompt FROM events)")
def answer_cache(spark: SparkSession, d: str) -> DataFrame:
    """Answers from a cache that has those of errors, and a stub for each purchase; the rest come from the deterministic provider.

    Its answers are stubs, which are never cached and never taken from a cache.
    """
    prompts = A.event_nodes(spark, d).select(F.col("name").alias("prompt"))
    own = E.Provider()
    key = F.substring(F.sha2(F.concat(F.lit(own.namespace + "\n"), "prompt"), 256), 1, 32)
    cache = prompts.where("prompt like 'error%' or prompt like 'purchase%'").select(key.alias("key"), F.concat(F.when(F.col("prompt").startswith("error"), "kept ").otherwise("(stub) old "), "prompt").alias("answer"))
    got, new = E.answered(prompts, cache, own)
    return got.withColumn("n_cached", F.lit(new.count()))


# --- enrichment and view state


_CARD = "CASE WHEN semantic_kind <> 'CALLS' THEN 'db.query(' || name || ')' ELSE name END"


@query(CO + f", n AS (SELECT id, name, {_CARD} AS code FROM cnodes WHERE kind = 'function') SELECT id, 'unknown' AS intent, 'low' AS complexity, 'medium' AS criticality, CASE WHEN contains(lower(code), 'query') THEN 'database' ELSE 'none' END AS side_effects, 'heuristic' AS summary_source FROM n")
def enriched_functions(spark: SparkSession, d: str) -> DataFrame:
    """Every callable with rule-based semantics."""
    code = F.when(F.col("semantic_kind") != "CALLS", F.concat(F.lit("db.query("), "name", F.lit(")"))).otherwise(F.col("name"))
    nodes = A.commerce_nodes(spark, d).select("id", "name", "kind", "type", code.alias("code"), F.lit("").alias("summary"), F.lit(None).cast("string").alias("summary_source"))
    return E.enrich(nodes).select("id", "intent", "complexity", "criticality", F.array_join("side_effects", ",").alias("side_effects"), "summary_source")


@query(CO + " SELECT id, CASE WHEN kind = 'type' THEN summary ELSE 'Functions in ' || file END AS summary, CASE WHEN kind = 'type' THEN 'llm' ELSE 'heuristic' END AS summary_source FROM cnodes")
def description_backfill(spark: SparkSession, d: str) -> DataFrame:
    """Stub and heuristic summaries replaced, real ones kept."""
    nodes = A.commerce_nodes(spark, d).withColumn("summary_source", F.when(F.col("kind") == "type", "llm").otherwise("heuristic"))
    return M.description_backfill(nodes, F.concat(F.lit("Functions in "), "file")).select("id", "summary", "summary_source")


_EDGE = "SELECT 'c' || o_custkey AS src, 'Supplier#' || lpad((o_custkey % 130)::VARCHAR, 9, '0') AS target_name, CASE WHEN o_orderstatus = 'F' THEN 0.8 ELSE 0.4 END AS confidence FROM orders WHERE o_orderkey % 50 = 0"


@query(f"WITH f AS ({_EDGE}), n AS (SELECT s_name, max('s' || s_suppkey) AS dst FROM supplier GROUP BY s_name) SELECT src, dst, 'DEPENDS_ON' AS type, confidence::DOUBLE AS confidence, CASE WHEN confidence > 0.5 THEN 'bob' ELSE 'heuristic' END AS inferred_by FROM f JOIN n ON s_name = target_name")
def semantic_edges(spark: SparkSession, d: str) -> DataFrame:
    """Edges inferred to names, resolved to nodes."""
    o = A.load(spark, d, "orders").where("o_orderkey % 50 = 0")
    found = o.select(F.concat(F.lit("c"), "o_custkey").alias("src"), F.concat(F.lit("Supplier#"), F.lpad((F.col("o_custkey") % 130).cast("string"), 9, "0")).alias("target_name"), F.lit("DEPENDS_ON").alias("type"), F.when(F.col("o_orderstatus") == "F", 0.8).otherwise(0.4).alias("confidence"))
    return R.semantic_edges(found, A.load(spark, d, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("id"), F.col("s_name").alias("name")))


_BIG = ", o AS (SELECT DISTINCT src, dst FROM cedges), oc AS (SELECT src AS id, string_agg(dst, ',' ORDER BY dst) AS outgoing FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY dst) AS r FROM o) WHERE r <= 10 GROUP BY src), ic AS (SELECT dst AS id, string_agg(src, ',' ORDER BY src) AS incoming FROM (SELECT *, row_number() OVER (PARTITION BY dst ORDER BY src) AS r FROM o) WHERE r <= 10 GROUP BY dst)"


@query(CO + _BIG + " SELECT n.id AS node_id, module AS module_id, module AS module_name, coalesce(outgoing, '') AS outgoing_calls, coalesce(incoming, '') AS incoming_calls, left(name || ' ' || summary, 600) AS code_snippet, summary AS responsibilities, 0.4::DOUBLE AS confidence FROM cnodes n LEFT JOIN oc ON oc.id = n.id LEFT JOIN ic ON ic.id = n.id")
def ingestion_payload(spark: SparkSession, d: str) -> DataFrame:
    """What a model gets of each node, with the fallback fields."""
    n = A.commerce_nodes(spark, d).withColumns({"code": F.concat_ws(" ", "name", "summary"), "intent": F.lit("unknown")})
    rows = E.ingestion_rows(n.drop("module"), n.select("id", "module"), n.select("module", F.col("module").alias("name")).distinct(), A.commerce_edges(spark, d))
    return rows.select("node_id", "module_id", "module_name", *[F.array_join(c, ",").alias(c) for c in ("outgoing_calls", "incoming_calls")], "code_snippet", F.array_join("responsibilities", ",").alias("responsibilities"), "confidence")


@query(_bfs_sql(2) + ", p AS (SELECT id, parent FROM s2), x AS (SELECT min(id) AS id FROM seed), d1 AS (SELECT id FROM p WHERE parent = (SELECT id FROM x)), d2 AS (SELECT id FROM p WHERE parent IN (SELECT id FROM d1)) SELECT id FROM p WHERE id NOT IN (SELECT id FROM d1 UNION ALL SELECT id FROM d2 UNION ALL SELECT id FROM x)")
def subtree_removed(spark: SparkSession, d: str) -> DataFrame:
    """A view without one seed and all that was expanded below it."""
    edges, seeds = A.event_edges(spark, d), _event_seeds(spark, d)
    found = G.bfs(edges, seeds, 2).select("id", "parent")
    return G.remove_subtree(found, edges, seeds.agg(F.min("id")).first()[0])[0].select("id")


def _deep_sql() -> str:
    return EV + ", seed AS (SELECT min(id) AS id, 1 AS pos FROM enodes)" + queue_sql(3) + " SELECT id, hop, parent FROM s3 WHERE hop > 0 ORDER BY visit LIMIT 60"


@query(_deep_sql())
def deep_expansion(spark: SparkSession, d: str) -> DataFrame:
    """Up to sixty nodes within three hops of one."""
    return G.deep_expand(A.event_edges(spark, d), A.event_nodes(spark, d).agg(F.min("id")).first()[0])


_MIN = "(SELECT min(id) FROM enodes)"


@query(EV + f" SELECT {_MIN} AS id UNION SELECT dst FROM eedges WHERE src = {_MIN} UNION SELECT src FROM eedges WHERE dst = {_MIN}")
def hover_neighbours(spark: SparkSession, d: str) -> DataFrame:
    return G.hover(A.event_edges(spark, d), A.event_nodes(spark, d).agg(F.min("id")).first()[0])


@query(CO + " SELECT id, name FROM cnodes WHERE kind = 'type' UNION ALL SELECT id, upper(name) FROM cnodes WHERE kind <> 'type'")
def view_merged(spark: SparkSession, d: str) -> DataFrame:
    """A query's nodes merged into a view, whose own rows stay."""
    n = A.commerce_nodes(spark, d).select("id", "name", "kind")
    return G.merge_view(n.where("kind = 'type'").select("id", "name"), n.select("id", F.upper("name").alias("name")))


@query(CO + " SELECT DISTINCT module FROM cnodes WHERE file IN (SELECT r_name || '/' || n_name FROM nation JOIN region ON r_regionkey = n_regionkey WHERE n_nationkey < 3)")
def affected_modules(spark: SparkSession, d: str) -> DataFrame:
    """Modules with a changed file."""
    n = A.commerce_nodes(spark, d).select("module", "file")
    changed = A.load(spark, d, "nation").where("n_nationkey < 3").join(A.load(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.concat_ws("/", "r_name", "n_name").alias("file"))
    return G.affected_modules(n, changed)


@query(CO + ", g AS (SELECT file FROM cnodes WHERE id IN ('c1', 'c2', 's1')), kept AS (SELECT * FROM cnodes WHERE file NOT IN (FROM g)) SELECT 'node' AS part, id AS a, '' AS b FROM kept UNION ALL SELECT 'node', 'new', '' UNION ALL SELECT 'edge', src, dst FROM cedges WHERE src IN (SELECT id FROM kept) AND dst IN (SELECT id FROM kept) UNION ALL SELECT 'edge', 'new', 'new2'")
def graph_after_change(spark: SparkSession, d: str) -> DataFrame:
    """A graph after some files changed: only edges whose ends are both kept stay."""
    n = A.commerce_nodes(spark, d).select("id", F.col("file").alias("path"))
    changed = n.where("id in ('c1', 'c2', 's1')").select("path")
    nodes, edges = R.merge_graph(n, A.commerce_edges(spark, d), spark.createDataFrame([("new", "x")], "id string, path string"), spark.createDataFrame([("new", "new2")], "src string, dst string"), changed)
    return nodes.select(F.lit("node").alias("part"), F.col("id").alias("a"), F.lit("").alias("b")).union(edges.select(F.lit("edge"), "src", "dst"))


@query(EV + ", x AS (SELECT src, dst FROM eedges WHERE w = 1 AND src < dst), y AS (SELECT DISTINCT dst AS src, src AS dst FROM eedges) SELECT src, dst FROM x UNION ALL SELECT src, dst FROM y WHERE src <> dst AND (src, dst) NOT IN (SELECT (src, dst) FROM x)")
def extra_static_edges(spark: SparkSession, d: str) -> DataFrame:
    """New pairs of another analysis added to the edges."""
    e, n = A.event_edges(spark, d), A.event_nodes(spark, d)
    return R.extra_edges(e.where("w = 1 and src < dst"), e.select(F.col("dst").alias("src"), F.col("src").alias("dst")), n)


@query(with_("ev") + ", h AS (SELECT node, count(*) AS n FROM ev GROUP BY node ORDER BY n DESC, node LIMIT 10) SELECT node AS id, split_part(node, ':', 1) AS file, n FROM h")
def hot_nodes_enriched(spark: SparkSession, d: str) -> DataFrame:
    """Hot nodes with their names and files."""
    hot = A.events(spark, d).groupBy("node").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "node").limit(10)
    return hot.join(A.event_nodes(spark, d).select(F.col("id").alias("node"), F.col("kind").alias("file")), "node").select(F.col("node").alias("id"), "file", "n")

