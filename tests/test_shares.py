"""Shares of tasks: rows that compress to few bytes are still dealt to all tasks, and no step makes the same rows twice."""

from pyspark.sql import functions as F

from loomgraph import storage
from loomgraph.operators import graph as G
from loomgraph.operators import knowledge as K
from loomgraph.operators import modules as M
from loomgraph.operators import stateful as S
from loomgraph.plans import adapters as A
from loomgraph.plans import graph_queries as GQ
from loomgraph.plans import module_queries as MQ


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_calls_of_a_view_meet_their_modules_once(spark, sf):  # calls and flow each joined all edges with their ends
    n, e, m = MQ.graph(spark, sf)
    for depth in (2, 3):
        nodes, edges = M.view(n, m, e, depth)
        assert "Join" not in _plan(edges.where("kind in ('FLOW', 'CALLS')"))


def test_notes_meet_only_the_spans_of_their_files(spark, monkeypatch):  # F15, F16: all spans were exploded, in as few tasks as files
    got, best = [], K.innermost
    monkeypatch.setattr(K, "innermost", lambda notes, spans, *a: (got.append(spans.count()), best(notes, spans, *a))[1])
    sources = spark.createDataFrame([("a.py", "def f():\n    # TODO: look at this again\n    pass")] + [(f"b{k}.py", "pass") for k in range(9)], "path string, text string")
    nodes = spark.createDataFrame([("f", "f", "callable", "a.py", 1, 3)] + [(f"g{k}", "g", "callable", f"b{k}.py", 1, 1) for k in range(9)], "id string, name string, kind string, file string, start int, end int")
    notes = K.rationale(sources, nodes).collect()
    assert got == [1] and [(r.marker, r.file, r.line, r.node) for r in notes] == [("TODO", "a.py", 2, "f")]


def test_lines_and_names_are_dealt_to_all_tasks(spark):  # few shuffled bytes were merged into one task
    docs = spark.createDataFrame([(f"d{k}.md", "# a\nuses `load_it()`\n") for k in range(8)], "path string, text string").coalesce(1)
    nodes = spark.createDataFrame([(f"n{k}", "load_it", "callable", "x.py") for k in range(8)], "id string, name string, kind string, file string").coalesce(1)
    for df in (K.lines(docs), K.doc_edges(docs, nodes)):
        assert df.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert "REPARTITION_BY_NUM" in _plan(K.name_index(nodes))
    assert sorted({r.target for r in K.doc_edges(docs, nodes).collect()}) == ["n0", "n1", "n2"]


def test_a_report_makes_its_calls_once(spark, sf, monkeypatch):  # F16: once for each of three sections
    made, edges = [], A.commerce_edges
    monkeypatch.setattr(A, "commerce_edges", lambda *a: (made.append(1), edges(*a))[1])
    monkeypatch.setattr(GQ, "_report_parts", lambda *a: {})
    monkeypatch.setattr(GQ.X, "report", lambda parts, kind: parts)
    parts = GQ.architecture_report(spark, sf)
    assert len(made) == 1 and "orderkey" not in "".join(_plan(parts[p]) for p in ("high_risk", "dead_code", "couplings"))


def test_pairs_of_customers_are_dealt_by_customer(spark, sf):  # by both ends, and again for each join
    plan = _plan(A.commerce_edges(spark, sf))
    assert "REPARTITION_BY_NUM" in plan and "hashpartitioning(src#" in plan and not __import__("re").search(r"hashpartitioning\(src#\d+, dst#", plan)


def test_one_budget_is_folded_range_by_range(spark):  # one task sorted all rows
    rows = [(k, (k * 37 % 500) // 2 * 10.0) for k in range(500)] + [(900, None)]
    df = spark.createDataFrame(rows, "id long, s double").selectExpr("id", "timestamp_millis(cast(s * 1000 as long)) as ts", "'all' as b")
    for limit, seconds in ((5, 60.0), (40, 300.0)):
        want = {r.id: r.allowed for r in S.greedy_limit(df.where("ts is not null"), "b", "ts", "id", limit, seconds).collect()}
        got = {r.id: r.allowed for r in S.one_limit(df.where("ts is not null"), "ts", "id", limit, seconds, most=60).collect()}
        assert got == want and 0 < sum(got.values()) < 500
    everything = {r.id: r.allowed for r in S.greedy_limit(df, "b", "ts", "id", 5, 60.0).collect()}
    assert {r.id: r.allowed for r in S.one_limit(df, "ts", "id", 5, 60.0, most=60).collect()} == everything
    assert S.one_limit(df.limit(0), "ts", "id", 5, 60.0).count() == 0


def test_calls_are_made_distinct_before_their_ends_are_looked_up(spark, sf):  # a task held all calls that 64 MB compress
    plan = _plan(GQ.call_graph(spark, sf))
    top = plan[: plan.index("Join")]
    assert "Aggregate" not in top


def test_tasks_of_calls_grow_with_the_lines(spark, sf, monkeypatch):  # their number was fixed, so each spilled as the table grew
    monkeypatch.setattr(storage, "SHARE", 100)
    n = A.load(spark, sf, "lineitem").count()
    assert A.commerce_edges(spark, sf).rdd.getNumPartitions() == GQ._ends(spark, sf).rdd.getNumPartitions() == -(-n // 100)
    keys = ["src", "dst", "sf", "tf"]
    few = sorted(map(tuple, GQ._ends(spark, sf).select(*keys).collect()))
    monkeypatch.undo()
    assert few == sorted(map(tuple, GQ._ends(spark, sf).select(*keys).collect()))


def test_flows_make_their_calls_once(spark, sf, monkeypatch):  # once for counts, once for first calls, once for imports
    made, pairs = [], A._pairs
    monkeypatch.setattr(A, "_pairs", lambda *a, **k: (made.append(1), pairs(*a, **k))[1])
    plan = _plan(GQ.verified_flow_edges(spark, sf))
    assert made == [1] and "orderkey" not in plan


def test_first_calls_of_a_pair_over_many_tasks(spark):  # counted and kept task by task
    rows = [(f"a{k}", f"b{k % 7}", "x", "y", k == 399 or None) for k in range(400)] + [("a", "b", "x", "z", False), ("c", "d", None, "z", True)]
    calls = spark.createDataFrame(rows, "src string, dst string, sf string, tf string, seen boolean").repartition(9)
    first = sorted(f"a{k}>b{k % 7}" for k in range(400))[:10]
    assert [tuple(r) for r in G.verified_flows(calls, "seen").collect()] == [("x", "y", 400, first, "Valid: 400 direct calls with import")]
    both = {r["dst"]: (r["n"], r["pairs"], r["reason"]) for r in G.verified_flows(calls).collect()}
    assert both == {"y": (400, first, "Valid: 400 direct calls"), "z": (1, ["a>b"], "Valid: 1 direct calls")}
    assert G.verified_flows(calls.limit(0), "seen").count() == 0


def test_a_report_lets_spark_broadcast_nothing_by_itself(spark, sf, monkeypatch):  # ids of all nodes went through the driver
    seen, was = [], spark.conf.get(storage.THRESHOLD)
    monkeypatch.setattr(GQ, "_report_parts", lambda *a: (seen.append(spark.conf.get(storage.THRESHOLD)), {})[1])
    monkeypatch.setattr(GQ.X, "report", lambda parts, kind: (seen.append(spark.conf.get(storage.THRESHOLD)), parts)[1])
    parts = GQ.architecture_report(spark, sf)
    assert seen == ["-1", "-1"] and spark.conf.get(storage.THRESHOLD) == was
    with storage.merged(spark), storage.merged(spark):
        small = spark.range(3).join(spark.range(2), "id")
        assert "BroadcastHashJoin" not in _plan(small) and "BroadcastHashJoin" not in _plan(parts["documents"])
    assert spark.conf.get(storage.THRESHOLD) == was


def test_a_section_is_written_before_the_next(spark):  # one plan made all sections, and held their broadcasts, at once
    ids = spark.createDataFrame([("a", 1), ("b", 2)], "id string, degree long")
    god = ids.select("id", F.lit(1.0).alias("score"), F.lit(1.0).alias("pagerank"), F.lit(1).alias("in_degree"), F.lit(1).alias("out_degree"))
    got = GQ.X.report({"god_nodes": god.join(ids, "id"), "bridges": ids.join(god, "id")}, "library")
    plan = _plan(got)
    assert "Join" not in plan and "Exchange" not in plan
    assert [r.line for r in got.where("section = 'Architectural Bottlenecks'").orderBy("pos").collect()] == ["- `b` — degree 2", "- `a` — degree 1"]
