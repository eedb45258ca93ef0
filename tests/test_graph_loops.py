"""Traversal, paths, PageRank, strong components, cycles and communities against brute force on random graphs."""

import random
from collections import defaultdict, deque
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from loomgraph.operators import graph as G
from loomgraph.operators import louvain as L
from loomgraph.operators import strong as C
from loomgraph.operators import traverse as T
from loomgraph.plans import registry


def random_edges(n, m, seed):
    rng = random.Random(seed)
    return sorted({(f"n{a:02}", f"n{b:02}") for a, b in (rng.sample(range(n), 2) for _ in range(m))})


def table(spark, edges):
    return spark.createDataFrame(edges, "src string, dst string")


def queue(edges, seeds, hops):
    """First come, first served: what is visited when, and who called it first."""
    out, near = {}, defaultdict(list)
    for a, b in sorted(edges):
        near[a].append(b)
    parent, todo = {}, deque((s, 0) for s in seeds)
    while todo:
        v, hop = todo.popleft()
        if v in out:
            continue
        out[v] = (hop, len(out))
        if hop < hops:
            for w in near[v]:
                if w not in out and w not in parent:
                    parent[w] = v
                todo.append((w, hop + 1))
    return {(v, hop, parent.get(v), visit) for v, (hop, visit) in out.items()}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_visit_order(spark, seed, monkeypatch):
    edges = random_edges(30, 70, seed)
    seeds = ["n07", "n03", "n21"]
    pos = spark.createDataFrame([(s, k) for k, s in enumerate(seeds)], "id string, pos int")
    for bound in (200_000, 0):  # broadcast and numbered in a task, or shuffled and numbered in ranges
        monkeypatch.setattr(T, "BROADCAST_ROWS", bound)
        got = G.bfs(table(spark, edges), pos, 3)
        assert {(r["id"], r["hop"], r["parent"], r["visit"]) for r in got.collect()} == queue(edges, seeds, 3)


def test_a_seed_called_by_an_earlier_one(spark):
    seeds = spark.createDataFrame([("b", 1), ("a", 2)], "id string, pos int")
    got = {tuple(r) for r in G.bfs(table(spark, [("b", "a"), ("a", "b"), ("a", "c")]), seeds, 2).collect()}
    assert got == {("b", 0, None, 0), ("a", 0, "b", 1), ("c", 1, "a", 2)}
    none = spark.createDataFrame([], "id string, pos int")
    assert G.bfs(table(spark, [("a", "b")]), none, 2).count() == 0


def test_dense_numbers(spark):
    rng = random.Random(3)
    rows = [(f"k{rng.random():.9f}", i) for i in range(500)]
    got = T.numbered(spark.createDataFrame(rows, "k string, i int"), "at", F.desc("k")).collect()
    assert [r["i"] for r in sorted(got, key=lambda r: r["at"])] == [i for _, i in sorted(rows, reverse=True)]
    assert [r["at"] for r in sorted(got, key=lambda r: r["at"])] == list(range(500))


def test_a_round_shuffles_no_edges(spark, capsys):
    edges = T.adjacency(table(spark, random_edges(20, 40, 5)))
    front = spark.createDataFrame([("n01",)], "src string")
    edges.join(front.hint("merge"), "src").explain()
    plan = capsys.readouterr().out
    left = plan[plan.index("SortMergeJoin") :].split("+- Sort", 2)[0]
    assert "Bucketed: true" in plan and plan.count("Exchange") == 1 and "Exchange" not in left


@pytest.mark.parametrize("bound", [200_000, 0])
def test_shortest_paths(spark, bound, monkeypatch):
    monkeypatch.setattr(T, "BROADCAST_ROWS", bound)
    edges = random_edges(18, 30, 11) + [("n00", "n0"), ("n0", "n17"), ("n00", "n0!"), ("n0!", "n17")]
    near = defaultdict(set)
    for a, b in edges:
        near[a].add(b)
    for a, b in [("n00", "n17"), ("n03", "n16"), ("n05", "n05"), ("n17", "n00")]:
        best, todo = None, [[a]]
        while todo and best is None:
            done = [p for p in todo if p[-1] == b]
            best = min(">".join(p) for p in done) if done else None
            todo = [[*p, w] for p in todo for w in near[p[-1]] if w not in p]
        got = [r["path"] for r in G.shortest_path(table(spark, edges), a, b).collect()]
        assert got == ([best] if best else [])


@pytest.mark.parametrize("bound", [200_000, 0])
def test_pagerank(spark, bound, monkeypatch):
    monkeypatch.setattr(T, "BROADCAST_ROWS", bound)
    edges = random_edges(25, 60, 4) + [("n01", "dangling")]
    names = sorted({x for e in edges for x in e} | {"alone"})
    n, out = len(names), defaultdict(list)
    for a, b in edges:
        out[a].append(b)
    rank, rounds = dict.fromkeys(names, 1 / n), 0
    while True:
        idle = sum(rank[v] for v in names if v not in out)
        new = dict.fromkeys(names, 0.15 / n + 0.85 * idle / n)
        for a, b in edges:
            new[b] += 0.85 * rank[a] / len(out[a])
        change, rank, rounds = sum(abs(new[v] - rank[v]) for v in names), new, rounds + 1
        if change < n * 1e-6:
            break
    nodes = spark.createDataFrame([(v,) for v in names], "id string")
    got = dict(G.pagerank(nodes, table(spark, edges)).collect())
    assert rounds > 10 and all(abs(got[v] - rank[v]) < 1e-12 for v in names)
    assert abs(sum(dict(G.pagerank(nodes, table(spark, edges), rounds=3).collect()).values()) - 1) < 1e-9
    assert G.pagerank(nodes.limit(0), table(spark, edges)).count() == 0


def reached(edges):
    near = defaultdict(set)
    for a, b in edges:
        near[a].add(b)
    out = {}
    for v in {x for e in edges for x in e}:
        seen, todo = set(), [v]
        while todo:
            for w in near[todo.pop()] - seen:
                seen.add(w)
                todo.append(w)
        out[v] = seen
    return out


@pytest.mark.parametrize("n,m,seed", [(30, 40, 1), (40, 52, 2), (12, 40, 3), (20, 14, 4)])
def test_strong_components(spark, n, m, seed):
    edges = random_edges(n, m, seed) + [("loop", "loop"), ("p", "q"), ("q", "p"), ("q", "r")]
    to = reached(edges)
    want = {v: min(w for w in to[v] if v in to[w]) for v in to if any(w != v and v in to[w] for w in to[v])}
    assert dict(C.strong_components(table(spark, edges)).collect()) == want and {"p", "q"} <= set(want)


def all_cycles(edges, longest):
    near = defaultdict(set)
    for a, b in edges:
        near[a].add(b)
    out, todo = set(), [(v,) for v in near]
    for _ in range(longest):
        out |= {p for p in todo if p[0] in near[p[-1]] and len(p) > 1}
        todo = [(*p, w) for p in todo for w in near[p[-1]] if w > p[0] and w not in p]
    return out


def test_cycles_and_names(spark):
    edges = random_edges(14, 34, 8) + [("z1", "z2"), ("z2", "z1"), ("z2", "z3"), ("z3", "z2")]
    want = all_cycles(edges, 5)
    got = {tuple(r["path"].split(">")) for r in C.cycles(table(spark, edges), longest=5).collect()}
    assert got == want and len(want) > 5
    name = lambda v: "same" if v in ("z1", "z2") else v
    names = spark.createDataFrame([(v, name(v)) for v in {x for e in edges for x in e}], "id string, name string")
    got = {tuple(r["path"].split(">")) for r in C.cycles(table(spark, edges), names, longest=5).collect()}
    assert got == {p for p in want if len({name(v) for v in p}) > 1} and got != want


def test_cycles_within_budget(spark):
    whole = [(f"k{a}", f"k{b}") for a in range(7) for b in range(7) if a != b] + [("x", "y"), ("y", "w"), ("w", "x")]
    got = C.cycles(table(spark, whole), longest=4, budget=10)
    paths = {r["path"] for r in got.collect()}
    every = all_cycles(whole, 4)
    assert {tuple(p.split(">")) for p in paths} < every and "w>x>y" in paths and sum(p.count(">") == 1 for p in paths) == 21
    assert C.cycles(table(spark, [("a", "b"), ("b", "c")])).count() == 0


def test_no_open_path_is_dropped(spark, monkeypatch):  # of a component's open paths 200,000 went on, the rest were lost
    monkeypatch.setattr(C, "_within", lambda path, budget: path.limit(0))
    whole = [(f"k{a}", f"k{b}") for a in range(6) for b in range(6) if a != b]
    got = C.cycles(table(spark, whole), longest=5)
    assert {tuple(r["path"].split(">")) for r in got.collect()} == all_cycles(whole, 5)


def test_components_of_one_name_open_no_path(spark, monkeypatch):  # without a budget their paths would be all that grow
    alike = [(f"s{a}", f"s{b}") for a in range(6) for b in range(6) if a != b]
    mixed = [("x", "y"), ("y", "z"), ("z", "x"), ("s0", "x")]
    names = spark.createDataFrame([(f"s{a}", "same") for a in range(6)] + [(v, v) for v in "xyz"], "id string, name string")
    seen, write = [], C.written
    monkeypatch.setattr(C, "written", lambda df: (seen.append(df) if "nodes" in df.columns else None, write(df))[1])
    assert [tuple(r) for r in C.cycles(table(spark, alike + mixed), names, longest=5).collect()] == [(3, "x>y>z")]
    assert {r["first"] for df in seen for r in df.select("first").collect()} == {"x"}


def test_betweenness_takes_all_sources(spark):  # beyond 800 nodes it was scaled up from 200 sources, the SQL's is not
    edges = table(spark, [(f"a{k}", "hub") for k in range(450)] + [("hub", f"b{k}") for k in range(450)])
    nodes = edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct()
    got = dict(G.betweenness(nodes, edges).where("betweenness > 0").collect())
    assert got == {"hub": pytest.approx(450 * 450 / (900 * 899), abs=1e-12)}


def quality(edges, group):
    pairs = {tuple(sorted(e)) for e in edges if e[0] != e[1]}
    m, degree = len(pairs), defaultdict(int)
    for a, b in pairs:
        degree[group[a]] += 1
        degree[group[b]] += 1
    return sum(group[a] == group[b] for a, b in pairs) / m - sum(d * d for d in degree.values()) / (4 * m * m)


def greedy(spark, nodes, edges):
    return dict(G.communities(nodes, table(spark, edges)).collect())


@pytest.mark.parametrize("kind,seed", [("cliques", 1), ("random", 2), ("planted", 3)])
def test_louvain_is_as_good_as_greedy(spark, kind, seed):
    rng = random.Random(seed)
    if kind == "cliques":
        edges = [(f"c{c}{a}", f"c{c}{b}") for c in range(6) for a, b in combinations(range(5), 2)] + [(f"c{c}0", f"c{(c + 1) % 6}1") for c in range(6)]
    elif kind == "random":
        edges = random_edges(24, 50, seed)
    else:
        edges = [(f"n{a:02}", f"n{b:02}") for a, b in combinations(range(30), 2) if rng.random() < (0.6 if a % 3 == b % 3 else 0.05)]
    nodes = spark.createDataFrame([(v,) for v in sorted({x for e in edges for x in e})], "id string")
    got = dict(L.louvain(table(spark, edges)).collect())
    best = greedy(spark, nodes, edges)
    assert set(got) == set(best) and quality(edges, got) >= quality(edges, best) - 1e-9
    assert all(got[v] <= v for v in got) and {got[c] for c in got.values()} == set(got.values())
    pairs = spark.createDataFrame([(*p, 1.0) for p in {tuple(sorted(e)) for e in edges}], "a string, b string, w double")
    assert abs(L.modularity(pairs, spark.createDataFrame(list(got.items()), "id string, c string")) - quality(edges, got)) < 1e-9


def test_louvain_without_edges_and_beyond_the_broadcast(spark, monkeypatch):
    assert L.louvain(table(spark, [("a", "a")])).count() == 0
    edges = [(f"c{c}{a}", f"c{c}{b}") for c in range(3) for a, b in combinations(range(4), 2)] + [("c00", "c10"), ("c11", "c20")]
    want = dict(L.louvain(table(spark, edges)).collect())
    monkeypatch.setattr(T, "BROADCAST_ROWS", 0)
    assert dict(L.louvain(table(spark, edges)).collect()) == want == {v: f"{v[:2]}0" for v in want}


def test_large_component_of_communities(spark):
    edges = [(f"c{c}{a}", f"c{c}{b}") for c in range(4) for a, b in combinations(range(4), 2)] + [(f"c{c}0", f"c{c + 1}1") for c in range(3)]
    nodes = spark.createDataFrame([(v,) for v in sorted({x for e in edges for x in e} | {"alone"})], "id string")
    got = dict(G.communities(nodes, table(spark, edges), most=10).collect())
    assert got == {v: v if v == "alone" else f"{v[:2]}0" for v in got} and len(got) == 17


def test_a_name_registers_once():
    _, _, query = registry.registry("tests.one")
    _, _, other = registry.registry("tests.two")

    def some_query_of_tests(spark, d):
        return None

    query("SELECT 1")(some_query_of_tests)
    for again in (query, other):
        with pytest.raises(ValueError, match="some_query_of_tests"):
            again()(some_query_of_tests)
