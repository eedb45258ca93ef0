"""Line dedup, the filter audit and the source audit against brute-force versions and SQL, on odd rows too."""

import hashlib
import itertools
import os
import random
import re
from collections import Counter, defaultdict

import duckdb
import pytest

from loomgraph.llm import filter_audit, line_dedup, queries, source_audit

SCHEMA = "doc_id long, text string, lang string, source string, k1 string, at string, n_lines int, parts string, mask int, term string, batch int"
OPS = ("op11_line_dedup", "op12_filter_audit", "op13_source_audit")


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def odd_rows():
    rng = random.Random(5)
    line = ["A common line of some length", "  a common LINE of some length\t", "another line that repeats often", "exactly twenty chars", "ünïcode line with ünïcode   inside", "short", "", "\x0b  \x0c", "x" * 20, "nineteen characters"]
    texts = [(i, "\n".join(rng.choice(line) for _ in range(rng.randrange(6)))) for i in range(1, 25)]
    texts += [(30, None), (31, ""), (32, "\n\n"), (33, "\n".join([line[0]] * 4)), (None, line[2] + "\n" + line[0]), (None, line[4]), (40, line[2]), (40, line[2]), (41, "\n".join(line) + "\n" + "w " * 300), (42, "ABC DEF " * 300 + "# one"), (43, "many words " * 40_000 + "\n" + line[0])]
    texts += [(50 + i, "the same text of ten words or so, again # " * 30) for i in range(4)]
    lang, source = ["en", "de", None], ["a", "b", None, "c"]
    return [(i, t, lang[k % 3], source[k % 4], "x", "y", 3, "z", 1, "t", 9) for k, (i, t) in enumerate(texts)]


def label_rows():
    return [(1, 1, 0), (2, 0, 1), (2, 1, 0), (43, 1, 1), (51, 1, None), (52, None, 1), (None, 1, 1), (999, 1, 1)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame(label_rows(), "doc_id long, quality int, toxic int")


def brute_lines(docs):
    strip = lambda x: low(re.sub(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "", x))
    has = defaultdict(list)
    for i, text in docs:
        for key in {strip(x) for x in (text or "").split("\n")}:
            if len(key) >= 20:
                has[key].append(i)
    last = {k: max((i for i in v if i is not None), default=None) for k, v in has.items() if len(v) >= 3}
    out = []
    for i, text in docs:
        lines = (text or "").split("\n")
        kept = [x for x in lines if strip(x) not in last or last[strip(x)] == i]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def deduped(docs, **more):
    n, gone = line_dedup.fresh(docs, "n_lines", "n_dropped")
    got = line_dedup.deduplicate(docs, **more).collect()
    return sorted(((r["doc_id"], r[n], r[gone], hashlib.sha256(r["text"].encode()).hexdigest()) for r in got), key=str)


@pytest.mark.parametrize("batches,fanout", [(1, 2), (4, 2), (5, 3), (7, 2)])
def test_lines(odd, batches, fanout):
    want = brute_lines([r[:2] for r in odd_rows()])
    assert sum(r[2] for r in want) > 20
    assert deduped(odd, batches=batches, fanout=fanout) == want


def test_lines_without_broadcast(odd, monkeypatch):
    monkeypatch.setattr(line_dedup, "small", lambda *a, **k: None)
    assert deduped(odd) == brute_lines([r[:2] for r in odd_rows()])


def test_lines_of_text_ids(odd):
    got = deduped(odd.withColumn("doc_id", odd["doc_id"].cast("string")))
    assert got == brute_lines([(None if r[0] is None else str(r[0]), r[1]) for r in odd_rows()])


def test_other_columns_stay(odd):
    got = line_dedup.deduplicate(odd)
    assert got.columns[: len(odd.columns)] == odd.columns and len(got.columns) == len(odd.columns) + 2
    assert {tuple(r[c] for c in ("k1", "at", "n_lines", "parts")) for r in got.collect()} == {("x", "y", 3, "z")}


def test_runs_settle_and_compact(spark):
    """Three batches of falling ids: what three documents had isn't added again, and two runs of a level become one."""
    runs = line_dedup.Runs(spark, fanout=2)
    batch = lambda rows: spark.createDataFrame(rows, "h1 long, h2 long, id long")
    assert {tuple(r) for r in runs.add(batch([(1, 1, 9), (1, 1, 8), (1, 1, 7), (2, 2, 9)])).collect()} == {(1, 1, 3, 9), (2, 2, 1, 9)}
    assert {tuple(r) for r in runs.add(batch([(1, 1, 6), (2, 2, 6), (3, 3, 6)])).collect()} == {(2, 2, 1, 6), (3, 3, 1, 6)}
    assert [len(level) for level in runs.levels] == [0, 1]
    assert {tuple(r) for r in runs.add(batch([(1, 1, 20), (2, 2, 3), (1, 2, 3)])).collect()} == {(1, 1, 1, 20), (2, 2, 1, 3), (1, 2, 1, 3)}
    assert {tuple(r) for r in runs.repeated().collect()} == {(1, 1, 20), (2, 2, 9)}
    assert [len(level) for level in runs.levels] == [1, 1]


def test_compaction_shuffles_nothing(spark, capsys):
    runs = line_dedup.Runs(spark, fanout=9)
    keys = spark.range(100).selectExpr("id as h1", "id as h2", "id")
    runs.add(keys)
    runs.add(keys.selectExpr("h1 + 5 as h1", "h2 + 5 as h2", "id + 200 as id"))
    runs.repeated().explain()
    assert "Exchange" not in capsys.readouterr().out


def brute_audit(docs, labels):
    good, toxic = ({i for i, *v in labels if v[k] == 1} for k in (0, 1))
    least = {}
    for i, t, *_ in docs:
        if i is not None:
            least[t or ""] = min(least.get(t or "", i), i)
    fails, parts = [], defaultdict(list)
    for i, t, lang, *_ in docs:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        f = {x for x, y in (("A", len(w) < 200), ("B", 100 * len(set(w)) < 50 * len(w)), ("C", 100 * len(re.findall("[A-Z]", t)) > 3 * len(t)), ("D", re.search("[#$%&*|]", t)), ("E", i is not None and i > least[t])) if y}
        fails.append(f)
        parts[lang or ""].append((f, i is not None and i in good, i is not None and i in toxic))
    out = set()
    for part, rows in parts.items():
        orders, shapley = ["".join(o) for o in itertools.permutations("ABCDE")], Counter()
        for o in orders:
            for k, x in enumerate(o):
                shapley[x] += sum(x in f and not f & set(o[:k]) for f, *_ in rows)
        for o in orders:
            for k, x in enumerate(o):
                gone = [(f, g, t) for f, g, t in rows if x in f and not f & set(o[:k])]
                out.add((part, o, k + 1, sum(not f & set(o[: k + 1]) for f, *_ in rows), len(gone), sum(x in f and bool(f & set(o[:k])) for f, *_ in rows), sum(f == {x} for f, *_ in rows), sum(g for _, g, _ in gone), sum(t for *_, t in gone), shapley[x]))
    return out


def test_filter_audit(odd, labels):
    got = [tuple(r) for r in filter_audit.audit(filter_audit.cells(odd, labels)).collect()]
    want = brute_audit(odd_rows(), label_rows())
    assert len(got) == len(want) == 1800 and set(got) == want
    assert all(any(r[k] for r in want) for k in range(3, 10))


def brute_sources(docs, ranks=200):
    words = lambda t: re.findall(r"[^\x00-\x60\x7B-\x7F]+", low(t))
    had, count, whole, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for _, t, lang, source, *_ in docs:
        lang, source, w = lang or "", source or "", words(t)
        had[lang].update(set(w))
        count[lang, source].update(w)
        whole[lang].update(w)
        groups[lang].add(source)
    out = set()
    for lang, sources in groups.items():
        kept = [t for t, n in had[lang].items() if n >= 3]
        v = len(kept)
        share = lambda c, n, v=v: 1 + 10**9 * (c + 1) // (n + v)
        p = {s: {t: share(count[lang, s][t], sum(count[lang, s][x] for x in kept)) for t in kept} for s in sources}
        q = {t: share(whole[lang][t], sum(whole[lang][x] for x in kept)) for t in kept}
        for s in sources:
            rows = {"pair": [(-sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept), o.encode()) for o in sources - {s}], "term": [(-((p[s][t] - q[t]) ** 2 // q[t]), t.encode()) for t in kept if count[lang, s][t] and p[s][t] > q[t]]}
            for part, found in rows.items():
                for k, (value, item) in enumerate(sorted(found)):
                    if part == "pair" or k < ranks:
                        out.add((lang, s, part, item.decode(), -value, k + 1))
    return out


@pytest.mark.parametrize("broadcast", [True, False])
def test_source_audit(odd, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(source_audit, "small", lambda *a, **k: None)
    got = [tuple(r) for r in source_audit.divergence(odd).collect()]
    want = brute_sources(odd_rows())
    assert len(got) == len(set(got)) and set(got) == want and {r[2] for r in want} == {"pair", "term"}


def test_source_audit_ranks_and_unkept_languages(spark):
    rows = [(k, f"w{k % 7} w{k % 5} common", "en", "ab"[k % 2]) for k in range(40)] + [(90, "alone here", "fr", "a"), (91, "", "fr", "b"), (92, None, "it", "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {tuple(r) for r in source_audit.divergence(docs, ranks=2).collect()}
    assert got == brute_sources(rows, 2)
    assert ("fr", "a", "pair", "b", 0, 1) in got and not any(r[0] == "it" for r in got)


def test_large_counts_stay_exact(spark):
    n, total = 3 * 10**12, 7 * 10**12
    df = spark.createDataFrame([(n, total, 12345)], "n long, t long, v long")
    assert df.select(source_audit.share(df.n, df.t, df.v)).first()[0] == 1 + 10**9 * (n + 1) // (total + 12345)


def test_empty_tables(spark, labels):
    none = spark.createDataFrame([], SCHEMA)
    assert not line_dedup.deduplicate(none).collect()
    assert not filter_audit.audit(filter_audit.cells(none, labels)).collect()
    assert not source_audit.divergence(none).collect()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for name in os.listdir(sf):
        con.sql(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{sf}/{name}'")
    return con


@pytest.mark.parametrize("name", OPS)
def test_against_sql(spark, sf, duck, name):
    got, want = queries.QUERIES[name](spark, sf), duck.sql(queries.SQL[name])
    cols = sorted(got.columns)
    assert sorted(want.columns) == cols
    a = sorted(tuple(r[c] for c in cols) for r in got.collect())
    at = [want.columns.index(c) for c in cols]
    assert a == sorted(tuple(r[i] for i in at) for r in want.fetchall())


def test_sql_of_odd_rows(spark, odd, labels):
    """The SQL gives the same on odd rows as the brute-force versions."""
    con = duckdb.connect()
    con.register("documents", odd.toArrow())
    con.register("labels", labels.toArrow())
    run = lambda name, *cols: [tuple(r) for r in con.sql(f"SELECT {', '.join(cols)} FROM ({queries.SQL[name]})").fetchall()]
    assert sorted(run("op11_line_dedup", "doc_id", "n_lines", "n_dropped", "kept_sha256"), key=str) == brute_lines([r[:2] for r in odd_rows()])
    assert set(run("op12_filter_audit", "part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")) == brute_audit(odd_rows(), label_rows())
    assert set(run("op13_source_audit", "lang", "source", "part", "item", "value", "rank")) == brute_sources(odd_rows())
