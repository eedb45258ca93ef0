"""Name and word indexes against scans, on random names and questions."""

import random

import pytest
from pyspark.sql import functions as F

from loomgraph.operators import resolve, retrieval, search

PARTS = ["load", "Save", "user", "Cart", "price", "token", "Parse", "graph", "x", "é"]


@pytest.fixture(scope="module")
def names():
    rng = random.Random(9)
    out = ["".join(rng.choice(PARTS) for _ in range(rng.randrange(1, 4))) for _ in range(300)] + ["a", "ab", "abc", "ABC", None, ""]
    return [(f"n{k:03}", name) for k, name in enumerate(out)]


@pytest.fixture(scope="module")
def index(spark, names):
    search.BLOCK, old = 16, search.BLOCK  # many blocks
    yield search.NameIndex.build(spark.createDataFrame(names, "id string, name string"))
    search.BLOCK = old


def test_names_that_hold_a_text(index, names):
    for part in ("load", "usercart", "ARSE", "é", "ab", "abc", "nowhere", "tokenpricegraph", "x"):
        got = {r["id"] for r in index.containing(part).collect()}
        assert got == {i for i, n in names if n is not None and part.lower() in n.lower()}, part


def test_ranked_names(index, names):
    low = [(n.lower(), i) for i, n in names if n is not None and "load" in n.lower()]
    want = [i for _, i in sorted(((0 if n == "loaduser" else 1 if n.startswith("loaduser") else 2), i) for n, i in low)][:10]
    assert [r["id"] for r in index.find("loadUser", "load").orderBy("pos").collect()] == want and len(want) == 10


def test_prefixes(spark, index, names):
    asked = ["l", "lo", "load", "USERC", "tokenp", "zz", "", "abcd", "a"]
    want = {}
    for q in asked:
        hits = [i for i, n in names if n is not None and q and n.lower().startswith(q.lower())]
        if hits:
            want[q] = min(hits)
    assert dict(index.by_prefix(spark.createDataFrame([(q,) for q in asked], "q string")).collect()) == want and len(want) == 6


def test_a_lookup_reads_its_buckets(index, capsys):
    index.candidates(["loa", "oad"])
    index.asked(["loa"]).explain()
    plan = capsys.readouterr().out
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [(bucket" in plan or "bucket#" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_resolution_by_name(spark, names):
    nodes = spark.createDataFrame([n for n in names if n[1]], "id string, name string")
    asked = [names[0][1], names[5][1].upper(), names[7][1][:3], "nope", "AB"]
    want = {}
    for q in asked:
        for tier, ok in enumerate((lambda n: n == q, lambda n: n.lower() == q.lower(), lambda n: n.lower().startswith(q.lower()))):
            hits = [i for i, n in names if n and ok(n)]
            if hits:
                want[q] = (min(hits), tier)
                break
    got = resolve.by_name(spark.createDataFrame([(q,) for q in asked], "q string").distinct(), nodes)
    assert {r["q"]: (r["id"], r["tier"]) for r in got.collect()} == want


def test_best_by_blocks_is_the_whole_scan(spark):
    rng = random.Random(4)
    words = ["error", "payment", "login", "cache", "order", "ship", "route", "graph", "tax", "zebra"]
    pick = lambda n: " ".join(rng.choice(words) for _ in range(rng.randrange(n)))
    rows = [(f"n{k:03}", pick(3).replace(" ", "_"), pick(6) if k % 7 else None, f"src/{rng.choice(words)}.py", rng.choice(["retrieval", "error_handling", "zebra"])) for k in range(250)]
    nodes = spark.createDataFrame(rows, "id string, name string, summary string, file string, intent string").cache()
    index = search.WordIndex.build(nodes, block=8)
    key = lambda df: [(r["pos"], r["id"], r["score"]) for r in df.orderBy("pos").collect()]
    for question in ("Where does a payment error go?", "zebra tax", "login", "nothing of this", "cache order ship route"):
        assert key(index.shortlist(question, 12)) == key(retrieval.shortlist(nodes, question, 12)), question
    few = search.WordIndex.build(nodes.limit(3), block=8)
    assert few.shortlist("zebra", 12).count() == 3
    assert search.WordIndex.build(nodes.limit(0)).shortlist("zebra").count() == 0


def test_gaps_give_the_numbers_back(spark):
    df = spark.createDataFrame([([0, 3, 4, 90],), ([],), ([7],)], "a array<int>")
    back = search._summed(search.gaps(F.col("a")), [])
    assert [[x["at"] for x in r["b"]] for r in df.select(back.alias("b")).collect()] == [[0, 3, 4, 90], [], [7]]


def test_words_of_a_row_are_merged_without_a_shuffle(spark, monkeypatch):  # each word of each field was shuffled by node first
    plans, stored = [], search._stored
    monkeypatch.setattr(search, "_stored", lambda df: (plans.append(df._jdf.queryExecution().executedPlan().toString()), stored(df))[1])
    rows = [("a", "load user", "load file file", "src", "load"), ("b", None, "user", "user", "cache"), ("c", "", "", "", "")]
    index = search.WordIndex.build(spark.createDataFrame(rows, "id string, name string, summary string, file string, intent string"), block=2)
    got = {(r.word, r.block): (r.n, r.documents, r.most, r.gaps, r.impacts) for r in index.postings.collect()}
    assert got[("load", 0)] == (1, 1, 5.5, [0], [5.5]) and got[("user", 0)] == (2, 2, 3.0, [0, 1], [3.0, 2.0]) and got[("cache", 0)] == (1, 0, 1.0, [1], [1.0])
    assert len(got) == 5 and len(plans) == 1 and "hashpartitioning(num" not in plans[0]
