"""Every query with SQL against DuckDB on the smallest tables, and graph algorithms against brute force."""

import itertools
import math
import os
import random
import subprocess
import sys
from collections import defaultdict, deque
from concurrent.futures import ThreadPoolExecutor

import duckdb
import pytest

from loomgraph.operators import graph as G
from loomgraph.operators import resolve as R
from loomgraph.operators import stateful as S
from loomgraph.plans import adapters as A
from loomgraph.plans import catalog
from loomgraph.sources import extract as X


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    return v.isoformat() if hasattr(v, "isoformat") else v


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for name in os.listdir(sf):
        con.sql(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{sf}/{name}'")
    return con


@pytest.fixture(scope="module")
def results(request, spark, sf):
    """Columns and rows of all selected queries, several at a time: most of them are many small jobs."""
    names = [i.callspec.params["name"] for i in request.session.items if getattr(i, "originalname", "") == "test_against_sql"]

    def run(name):
        got = catalog.QUERIES[name](spark, sf)
        return sorted(got.columns), got.collect()

    with ThreadPoolExecutor(6) as pool:
        return {name: pool.submit(run, name) for name in names}


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_against_sql(results, duck, name):
    cols, got = results[name].result()
    want = duck.sql(catalog.SQL[name])
    assert sorted(want.columns) == cols
    key = lambda r: tuple((v is None, str(v)) for v in r)
    a = sorted((tuple(norm(r[c]) for c in cols) for r in got), key=key)
    at = [want.columns.index(c) for c in cols]
    b = sorted((tuple(norm(r[i]) for i in at) for r in want.fetchall()), key=key)
    assert a == b


THIN = "SELECT DISTINCT 'c' || o_custkey AS src, 's' || l_suppkey AS dst FROM lineitem JOIN orders ON l_orderkey = o_orderkey"


def test_sql_sees_all_edges(duck):
    """The SQL's edge tables hold every pair."""
    assert duck.sql(A.with_("ev", "eedges") + " SELECT count(*), sum(w) FROM eedges").fetchall()[0][0] == 983
    assert set(duck.sql(A.with_("cedges") + " SELECT src, dst FROM cedges").fetchall()) == set(duck.sql(THIN).fetchall())


def test_betweenness_and_communities_see_all_edges(spark, sf, monkeypatch):
    seen = []
    monkeypatch.setattr(G, "betweenness", lambda nodes, edges: seen.append(edges) or nodes.selectExpr("id", "0.0 betweenness"))
    monkeypatch.setattr(G, "communities", lambda nodes, edges: seen.append(edges))
    for name in ("betweenness", "communities"):
        catalog.QUERIES[name](spark, sf)
    want = {tuple(r) for r in A.event_edges(spark, sf).collect()}
    assert len(want) == 983 and all({tuple(r) for r in e.collect()} == want for e in seen) and len(seen) == 2


def test_shortest_path_without_limit(spark, sf, monkeypatch):
    links = spark.createDataFrame([(f"n{i:02}", f"n{i + 1:02}") for i in range(33)], "src string, dst string")
    assert tuple(G.shortest_path(links, "n00", "n33").first()) == (33, ">".join(f"n{i:02}" for i in range(34)))
    assert G.shortest_path(links, "n33", "n00").count() == 0
    chain = spark.createDataFrame([("click:1", "m"), ("m", "n"), ("n", "o"), ("o", "view:2")], "src string, dst string")
    monkeypatch.setattr(A, "event_edges", lambda *_: chain)
    monkeypatch.setattr(A, "event_nodes", lambda *_: chain.selectExpr("src id").union(chain.selectExpr("dst id")))
    assert tuple(catalog.QUERIES["shortest_path"](spark, sf).first()) == (4, "click:1>m>n>o>view:2")


def test_prior_context_limits(spark, sf, monkeypatch):
    turns = spark.createDataFrame([("v", 0, "user", "old"), ("v", 1, "user", "q" * 300), ("v", 2, "assistant", "a" * 300)], "conv_id string, turn int, role string, text string")
    monkeypatch.setattr(A, "load", lambda *_: turns)
    assert catalog.QUERIES["prior_context_string"](spark, sf).first()["context"] == "user: " + "q" * 300 + " | assistant: " + "a" * 200


def test_commerce_edges_and_cut_nodes(spark, sf, duck):
    want = set(duck.sql(THIN).fetchall())
    assert len(want) == 1444 and {tuple(r) for r in A.commerce_edges(spark, sf).collect()} == want
    near = defaultdict(set)
    for a, b in want:
        near[a].add(b)
        near[b].add(a)

    def parts(banned):
        left, n = set(near) - {banned}, 0
        while left:
            n, todo = n + 1, [left.pop()]
            while todo:
                for w in near[todo.pop()] & left:
                    left.discard(w)
                    todo.append(w)
        return n

    whole = parts(None)
    cut = {v for v in near if parts(v) > whole}
    assert {r[0] for r in G.articulation_points(A.commerce_nodes(spark, sf), A.commerce_edges(spark, sf)).collect()} == cut


EDGES = [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e"), ("e", "f"), ("f", "d"), ("g", "h"), ("a", "c"), ("x", "x2")]


@pytest.fixture(scope="module")
def small(spark):
    names = sorted({x for e in EDGES for x in e} | {"alone"})
    return spark.createDataFrame([(n,) for n in names], "id string"), spark.createDataFrame(EDGES, "src string, dst string"), names


def reach(starts, edges, banned=None):
    seen, todo = set(starts), deque(starts)
    while todo:
        v = todo.popleft()
        for s, t in edges:
            for a, b in ((s, t), (t, s)):
                if a == v and b not in seen and b != banned:
                    seen.add(b)
                    todo.append(b)
    return seen


def test_articulation_and_components(small):
    nodes, edges, names = small
    want = {n for n in names if len({frozenset(reach([m], EDGES, n)) for m in reach([n], EDGES) - {n}}) > 1}
    for most in (200_000, 0):  # depth first in a task, and by blocks of tree edges
        assert {r[0] for r in G.articulation_points(nodes, edges, most).collect()} == want
    got = dict(G.connected(nodes, edges).collect())
    assert got == {n: min(reach([n], EDGES)) for n in names}


def test_cut_nodes_of_random_graphs(spark):
    rng = random.Random(7)
    for n, m in ((12, 12),):
        pairs = {tuple(sorted(rng.sample(range(n), 2))) for _ in range(m)}
        links = [(f"v{a:02}", f"v{b:02}") for a, b in pairs]
        names = [f"v{k:02}" for k in range(n)]
        want = {v for v in names if len({frozenset(reach([w], links, v)) for w in reach([v], links) - {v}}) > 1}
        nodes = spark.createDataFrame([(v,) for v in names], "id string")
        got = G.articulation_points(nodes, spark.createDataFrame(links, "src string, dst string"), 0)
        assert {r[0] for r in got.collect()} == want and want


def test_betweenness(small):
    nodes, edges, names = small
    def paths(s, t):  # noqa: E306
        todo, best = deque([[s]]), []
        while todo:
            p = todo.popleft()
            if best and len(p) > len(best[0]):
                break
            if p[-1] == t:
                best.append(p)
                continue
            todo.extend(p + [b] for a, b in EDGES if a == p[-1] and b not in p)
        return best
    want = defaultdict(float)  # noqa: E305
    for s, t in itertools.permutations(names, 2):
        best = paths(s, t)
        for p in best:
            for v in p[1:-1]:
                want[v] += 1 / len(best)
    n = len(names)
    for most in (2_000_000, 0):  # a search in a task, and all searches in joins
        got = dict(G.betweenness(nodes, edges, most_edges=most).collect())
        assert all(abs(got[v] - want[v] / ((n - 1) * (n - 2))) < 1e-9 for v in names)


def test_cycles_paths_communities(small):
    nodes, edges, names = small
    assert {r["path"] for r in G.cycles(edges).collect()} == {"a>b>c", "a>c", "d>e>f"} - ({"a>c"} if ("c", "a") not in EDGES else set())
    assert tuple(G.shortest_path(edges, "a", "f").first()) == (4, "a>c>d>e>f")
    assert G.shortest_path(edges, "f", "a").count() == 0
    groups = dict(G.communities(nodes, edges).collect())
    assert groups["d"] == groups["e"] == groups["f"] != groups["b"] and groups["alone"] == "alone"


def test_folds(spark):
    log = spark.createDataFrame([("k", float(t), i, f) for i, (t, f) in enumerate([(0, 1), (10, 1), (20, 1), (61, 0), (70, 0), (200, 0)])], "k string, t double, i int, f int")
    got = {r["i"]: r["allowed"] for r in S.greedy_limit(log, "k", "t", "i", 2, 60.0).collect()}
    assert got == {0: True, 1: True, 2: False, 3: True, 4: True, 5: True}
    states = [r["state"] for r in S.breaker(log, "k", "t", "i", log["f"] == 1, failures=3, rest=60.0, successes=1).orderBy("i").collect()]
    assert states == ["closed", "closed", "open", "open", "open", "closed"]
    assert [r["reused"] for r in S.reuse(log, ["k"], "t", "i", 30.0).orderBy("i").collect()] == [False, True, True, False, True, False]


def test_extract_and_resolve(spark, tmp_path):
    (tmp_path / "pkg").mkdir()
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "pkg" / "m.py").write_text("class A:\n    def f(self):\n        return self.g()\n    def g(self):\n        return top()\ndef top():\n    return 1\n")
    (tmp_path / "pkg" / "bad.py").write_text("def (")
    (tmp_path / "node_modules" / "x.js").write_text("function hidden() {}\n")
    (tmp_path / "w.cpp").write_text("class Widget {\n  void draw() {\n    compute(1);\n  }\n};\nint compute(int x) {\n  return x;\n}\n")
    rows = X.extract(X.scan_files(spark, str(tmp_path)))
    nodes = rows.where("row = 'node'").select("id", "name", "kind", "path")
    ids = {r["id"] for r in nodes.collect()}
    assert {"pkg/m.py::A", "pkg/m.py::A.f", "pkg/m.py::top", "w.cpp::Widget", "w.cpp::Widget.draw", "w.cpp::compute"} <= ids and not any("hidden" in i for i in ids)
    calls = R.resolve_calls(rows.where("row = 'edge' and relation = 'INVOKES'").select("id", "target", "receiver", "line", "adapter"), nodes)
    assert {(r["id"], r["target_id"], r["confidence"]) for r in calls.collect()} == {("pkg/m.py::A.f", "pkg/m.py::A.g", 0.95), ("pkg/m.py::A.g", "pkg/m.py::top", 0.80), ("w.cpp::Widget.draw", "w.cpp::compute", 0.65)}


def test_written_folders_go_with_the_driver(tmp_path):
    """A driver's folder under spark.checkpoint.dir is gone when it ends; a cluster without that setting is refused."""
    code = (
        "from loomgraph.session import local_session; from loomgraph import storage; import os, types\n"
        f"s = local_session(1, 1, **{{'spark.checkpoint.dir': 'file://{tmp_path}/cp'}})\n"
        "assert storage.written(s.range(3)).count() == 3\n"
        f"assert os.listdir('{tmp_path}/cp')\n"
        "conf = types.SimpleNamespace(get=lambda *a: None)\n"
        "sc = types.SimpleNamespace(applicationId='x', master='yarn', getConf=lambda: conf, _jsc=types.SimpleNamespace(sc=lambda: types.SimpleNamespace(getCheckpointDir=lambda: types.SimpleNamespace(isDefined=lambda: False))))\n"
        "try:\n    storage.shared_dir(types.SimpleNamespace(sparkContext=sc, conf=conf)); raise SystemExit('not refused')\n"
        "except RuntimeError as e:\n    assert 'spark.checkpoint.dir' in str(e)\n"
    )
    done = subprocess.run([sys.executable, "-c", code], cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__))), capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr[-2000:]
    assert not [x for x in os.listdir(tmp_path / "cp") if x.startswith("loom-")]


def test_entry_imports():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and len(e.queries()) > 80
