"""Updates against full rebuilds, innermost spans, folds of hot keys, extraction from tokens, and keyed streams against batches."""

import random

import pytest
from pyspark.sql import functions as F

from loomgraph.operators import intervals
from loomgraph.operators import learning as L
from loomgraph.operators import resolve as R
from loomgraph.operators import stateful as S
from loomgraph.sources import braces
from loomgraph.sources import extract as X
from loomgraph.streaming import keyed


def code_base(rng, files):
    """Python files whose functions call each other by names that several of them may have."""
    names = [f"f{k}" for k in range(8)]
    out = []
    for k in files:
        lines = [f"import m{rng.randrange(6)} as other", ""]
        for c in range(rng.randrange(2)):
            lines += [f"class C{k}{c}:", "    def __init__(self):", f"        self.x = C{rng.randrange(6)}0()", f"    def {rng.choice(names)}(self):", f"        self.{rng.choice(names)}()", f"        self.x.{rng.choice(names)}()", ""]
        for f in rng.sample(names, rng.randrange(1, 4)):
            lines += [f"def {f}():", f"    {rng.choice(names)}()", f"    other.{rng.choice(names)}()", f"    obj.{rng.choice(names)}()", ""]
        out.append((f"m{k}.py", "\n".join(lines)))
    return out


def parts(rows):
    asked = rows.where("row = 'edge' and relation = 'INVOKES'").select("id", "target", "receiver", "owner", "path", "adapter", "line")
    return asked, rows.where("row = 'node'"), rows.where("row = 'attr'"), rows.where("row = 'import'")


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_update_equals_rebuild(spark, seed):
    rng = random.Random(seed)
    old = code_base(rng, range(6))
    new = code_base(rng, [1, 4]) + code_base(rng, [7])
    changed = spark.createDataFrame([(p,) for p in ("m1.py", "m4.py", "m3.py", "m7.py")], "path string")  # m3 is deleted
    table = lambda x: X.extract(spark.createDataFrame(x, "path string, text string")).cache()
    asked, nodes, attrs, imports = parts(table(old))
    more = parts(table(new))
    whole = parts(table([f for f in old if f[0] not in ("m1.py", "m4.py", "m3.py")] + new))
    edges = R.resolve_calls(asked, nodes, attrs, imports)
    key = lambda df: sorted(tuple(r) for r in df.select("id", "target_id", "confidence").distinct().collect())
    _, got, now = R.update_calls(R.name_index(asked), edges, nodes, more[0], more[1], changed, whole[2], whole[3])
    want = key(R.resolve_calls(*whole))
    assert key(got) == want and want and {r["id"] for r in now.collect()} == {r["id"] for r in whole[1].collect()}
    assert want != key(edges)


def test_innermost_spans(spark):
    rng = random.Random(6)
    spans = [(f"f{rng.randrange(2)}", a, a + rng.randrange(40), f"s{k:02}") for k in range(60) for a in [rng.randrange(100)]] + [("f0", 90, None, "open"), ("f0", None, 5, "odd"), ("f1", 50, 49, "empty")]
    points = [(f"f{k % 2}", k // 2, k) for k in range(0, 240)] + [("f0", None, -1), ("f9", 3, -2), ("f0", 7, -3), ("f0", 2**31 - 1, -4)]
    got = intervals.innermost(spark.createDataFrame(points, "file string, line int, tag int"), spark.createDataFrame(spans, "file string, a int, b int, node string"), "file", "line", "a", "b", "node")
    want = {}
    for f, p, tag in points:
        hits = [((2**31 - 1 if b is None else b) - a, n) for g, a, b, n in spans if g == f and p is not None and a is not None and a <= p <= (2**31 - 1 if b is None else b)]
        want[tag] = min(hits)[1] if hits else None
    assert {r["tag"]: r["node"] for r in got.collect()} == want and got.columns == ["file", "line", "tag", "node"]


def test_dyadic_blocks_cover_each_place_once(spark):
    for a, b in ((0, 0), (3, 17), (0, 2**31 - 1), (5, 4), (2**31 - 2, 2**31 - 1)):
        got = spark.range(1).select(intervals.blocks(F.lit(a), F.lit(b)).alias("x")).first()["x"]
        ranges = sorted((x["block"] << x["level"], ((x["block"] + 1) << x["level"]) - 1) for x in got)
        assert sum(e - s + 1 for s, e in ranges) == max(0, b - a + 1) and all(x[1] + 1 == y[0] for x, y in zip(ranges, ranges[1:]))
        assert not ranges or (ranges[0][0], ranges[-1][1]) == (a, b)


def test_clamped_fold_of_a_hot_key(spark, monkeypatch):
    monkeypatch.setattr(S, "PIECE", 3)
    rng = random.Random(2)
    rows = [("hot" if k % 5 else f"k{k % 3}", k // 2, k, None if k % 11 == 0 else rng.choice([0.1, 0.2, -0.1, -0.3, 0.5])) for k in range(700)]
    got = S.clamped_fold(spark.createDataFrame(rows, "k string, t int, i int, d double").repartition(5), "k", ["t", "i"], F.col("d"))
    want = {}
    for k, _, _, d in sorted(rows, key=lambda r: (r[1], r[2])):
        if d is not None:
            want[k] = min(1.0, max(0.0, want.get(k, 0.0) + d))
    got = dict(got.collect())
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_reuse_by_doubling(spark):
    rng = random.Random(8)
    rows = [(rng.choice("ab"), rng.randrange(2), float(rng.randrange(400) if k % 3 else rng.randrange(5000)), k) for k in range(260)] + [("only", 0, 1.0, 999), (None, 0, 1.0, 1000)]
    got = {r["i"]: r["reused"] for r in S.reuse(spark.createDataFrame(rows, "k string, g int, t double, i int"), ["k", "g"], "t", "i", 30.0).collect()}
    last, want = {}, {}
    for k, g, t, i in sorted(rows, key=lambda r: (str(r[0]), r[1], r[2], r[3])):
        want[i] = k is not None and (k, g) in last and t - last[k, g] <= 30.0
        if not want[i]:
            last[k, g] = t
    assert got == want and 0 < sum(want.values()) < len(want)


SCRIPT = '''// class Fake { }
import x from "y"; const z = require('q')
/* function no() {} */
export default class A extends B.C {
  @dec
  async load(a, b) { if (a) { go("}"); } return `x ${y}`; }
  get size() { return this.n }
}
async function main() { await run(1); new Thing(2) }
const f = async (a: Map<string, number>): Promise<void> => { g(a) }
let h = x => k(x)
'''


def found(path, text, language):
    rows = braces.brace_symbols(path, text, language)
    return {(r["id"].split("::", 1)[1], r["line"], r["end_line"]) for r in rows if r["row"] == "node" and r["kind"] != "file"}, {(r["relation"], r["id"].split("::", 1)[1], r["target"]) for r in rows if r["row"] != "node" and r["relation"] != "CONTAINS"}


def test_script_tokens():
    nodes, edges = found("a.ts", SCRIPT, "typescript")
    assert nodes == {("A", 4, 8), ("A.load", 6, 6), ("A.size", 7, 7), ("main", 9, 9), ("f", 10, 10), ("h", 11, 11)}
    assert edges == {("DEPENDS_ON", "<file>", "y"), ("DEPENDS_ON", "<file>", "q"), ("EXTENDS", "A", "B.C"), ("INVOKES", "A.load", "go"), ("INVOKES", "main", "run"), ("INVOKES", "main", "Thing"), ("INVOKES", "f", "g"), ("INVOKES", "h", "k")}
    marks = [r["decorators"] for r in braces.brace_symbols("a.ts", SCRIPT, "typescript") if r.get("name") == "load"]
    assert marks == ["dec"]


def test_java_and_cpp_tokens():
    java = "import static a.b.C.*;\npublic final class Q<T extends Z> extends P<T> {\n  private int n = f(1);\n  public Q(int a) { super(a); }\n  @Override public <K> List<K> get(Map<K, V> m) throws IOException, E2 { for (K k : m) { use(k); } return null; }\n  abstract void no(int x);\n}\n"
    nodes, edges = found("a.java", java, "java")
    assert nodes == {("Q", 2, 7), ("Q.Q", 4, 4), ("Q.get", 5, 5)} and edges == {("DEPENDS_ON", "<file>", "a.b.C.*"), ("EXTENDS", "Q", "P"), ("INVOKES", "Q.get", "use")}
    cpp = "#include <vector>\nnamespace n {\ntemplate <class T> class V : public Base<T> { public: int size() const { return count_(); } };\nint* make(const char* s) { if (s) { return f(s); } return g(); }\n}\nint V::at(int i) {\n  return \"}\"[0];\n}\n"
    nodes, edges = found("a.cpp", cpp, "cpp")
    assert nodes == {("V", 3, 3), ("V.size", 3, 3), ("make", 4, 4), ("V::at", 6, 8)} and edges == {("DEPENDS_ON", "<file>", "vector"), ("EXTENDS", "V", "Base"), ("INVOKES", "V.size", "count_"), ("INVOKES", "make", "f"), ("INVOKES", "make", "g")}
    for text in ("", "{{{", "}}}", "class", "function (", "int f(", "/* open", "'", "a(b{c)d}"):
        for language in ("javascript", "typescript", "java", "c", "cpp"):
            assert braces.brace_symbols("x", text, language)[0]["kind"] == "file"


@pytest.fixture
def stateful_store(spark):
    old = {k: spark.conf.get(k, None) for k in keyed.STORE}
    for k, v in keyed.STORE.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@pytest.mark.parametrize("what", ["limit", "breaker"])
def test_stream_with_a_stop_equals_batch(spark, sf, tmp_path, stateful_store, what):
    """Events in order of time, in batches, stopped after half of them and started again: the batch's rows."""
    events = spark.read.parquet(f"{sf}/events.parquet").select("event_id", "user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    rows = sorted(events.collect(), key=lambda r: (r["ts"], r["event_id"]))
    failed = F.col("event_type") == "error"
    if what == "limit":
        make = lambda df: keyed.greedy_limit(df, "user_id", "ts", "event_id", 2, 86400.0)
        want = {r["event_id"]: r["allowed"] for r in S.greedy_limit(events, "user_id", "ts", "event_id", 2, 86400.0).collect()}
    else:
        make = lambda df: keyed.breaker(df, "user_id", "ts", "event_id", failed, failures=2)
        want = {r["event_id"]: r["state"] for r in S.breaker(events, "user_id", "ts", "event_id", failed, failures=2).collect()}
    for half in (rows[: len(rows) // 2], rows[len(rows) // 2 :]):
        for part in (half[: len(half) // 2], half[len(half) // 2 :]):
            spark.createDataFrame(part, events.schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        query = make(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start()
        query.awaitTermination(240)
        assert query.exception() is None
    got = spark.read.parquet(str(tmp_path / "out"))
    assert {r["tie"]: r[got.columns[2]] for r in got.collect()} == want and got.count() == len(want) and len(set(want.values())) > 1


def test_query_log(spark, tmp_path):
    """Questions asked in two sessions: later terms see both, and a batch without its queries doesn't count."""
    nodes = spark.createDataFrame([("a", "load_cart", "reads a cart", "cart.py", "retrieval"), ("b", "save_cart", "writes it", "cart.py", "persistence")], "id string, name string, summary string, file string, intent string")
    edges = spark.createDataFrame([("a", "b")], "src string, dst string")
    log = L.QueryLog(spark, str(tmp_path))
    query, found = log.ask(nodes, edges, "Where is the cart loaded?")
    assert {r["id"] for r in found.collect()} == {"a", "b"} and len(query) == 16
    assert log.ask(nodes, edges, "cart writes")[0] != query
    spark.createDataFrame([("cut off", 1, "zzz", 0.0)], L.QueryLog.NAMES).write.mode("append").parquet(f"{tmp_path}/names")
    terms = {r["term"]: r for r in L.QueryLog(spark, str(tmp_path)).terms().collect()}
    assert terms["cart"]["frequency"] == 2 and set(terms["cart"]["names"]) == {"load_cart", "save_cart"} and "zzz" not in str(terms)
