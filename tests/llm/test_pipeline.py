import base64
import hashlib
import math
import os
import random
import sys
from collections import Counter, defaultdict

import corpus_pipeline
from loomgraph.llm import common, decontaminate, langid, ngram_join, token_codes

sys.path.insert(0, os.path.dirname(__file__))


def test_stages(spark, sf):
    docs = common.table(spark, sf, "documents")
    names = set(docs.columns)
    seen = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = common.written(stage(spark, docs, sf))
        assert set(out.columns) == names, name
        seen.append((docs, out))
        docs = out
    ids = lambda df: {r[0] for r in df.select("doc_id").collect()}
    before, after = seen[0]
    assert ids(before) - ids(after) == {r["doc_id"] for r in langid.identify(before, langid.fit(before)).collect() if r["lang_pred"] == "und" or r["score"] < langid.LEAST_SCORE}
    before, after = seen[1]
    parts = {r["component_id"] for r in ngram_join.jaccard_components(before).collect()}
    assert ids(after) == parts and after.count() == len(parts)
    before, after = seen[2]
    assert ids(before) - ids(after) == {r["doc_id"] for r in decontaminate.contamination(before, common.table(spark, sf, "benchmark")).collect() if r["contaminated"]}
    before, after = seen[3]
    assert ids(after) <= ids(before) and after.count() > 0
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()
    assert len(last) == docs.count()


def test_stages_against_brute_force(spark, sf):
    """Near duplicates, decontamination and mixing recomputed row by row in Python from the documents themselves."""
    from test_operators import brute_components, brute_contamination

    docs = common.table(spark, sf, "documents")
    bench = common.table(spark, sf, "benchmark")
    given = [(r["doc_id"], r["text"]) for r in docs.collect()]
    first = {c for _, n, c in brute_components(given) if n} | {i for i, n, _ in brute_components(given) if not n}
    kept = common.written(corpus_pipeline.near_duplicates(spark, docs, sf))
    assert {r["doc_id"] for r in kept.collect()} == first
    hit = {i for i, *_, bad in brute_contamination([g for g in given if g[0] in first], [tuple(r) for r in bench.select("item_id", "text").collect()]) if bad}
    clean = common.written(corpus_pipeline.remove_benchmark(spark, kept, sf))
    assert {r["doc_id"] for r in clean.collect()} == first - hit and hit
    rows = clean.collect()
    size = defaultdict(int)
    for r in rows:
        size[r["source"]] += max(len(r["text"] or ""), 1)
    want = Counter()
    for r in rows:
        rate = sum(size.values()) / len(size) / size[r["source"]]
        u = int(hashlib.md5(f"mix-1:{r['doc_id']}".encode()).hexdigest()[:13], 16) / 2**52
        k, p = 0, math.exp(-rate)
        total = p
        while total <= u:
            k += 1
            p *= rate / k
            total += p
        if k:
            want[r["doc_id"]] = k
    got = Counter(r["doc_id"] for r in corpus_pipeline.mix_sources(spark, clean, sf).collect())
    assert got == want and max(want.values()) > 1


def test_odd_table_through_all_stages(spark, sf):
    """Nulls in every column, empty and very long texts, repeated rows and clashing names."""
    from test_operators import SCHEMA, odd_rows

    docs = spark.createDataFrame(odd_rows(), SCHEMA).repartition(3)
    names = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = common.written(stage(spark, docs, sf))
        assert docs.columns == names, name
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()
    assert len(last) == docs.count()


def test_language_rejects_lettered_text(spark):
    docs = common.table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text", "lang")
    model = langid.fit(docs)
    rng = random.Random(3)
    noise = [base64.b64encode(rng.randbytes(300)).decode(), "".join(rng.choice("abcdefghijklmnopqrstuvwxyz  ") for _ in range(400)), "Это предложение написано на языке, которого нет в таблице."]
    junk = spark.createDataFrame([(-1 - k, t, "en") for k, t in enumerate(noise)], docs.schema)
    kept = {r["doc_id"] for r in langid.keep_identified(docs.union(junk), model).collect()}
    lettered = {r["doc_id"] for r in docs.collect() if r["text"] and any(c.isalpha() for c in r["text"])}
    assert kept == lettered
    scores = {r["doc_id"]: r["score"] for r in langid.identify(junk, model).collect()}
    assert len(scores) == 3 and all(0 <= s < langid.LEAST_SCORE for s in scores.values())


def test_language_without_labels_keeps_all(spark):
    docs = spark.createDataFrame([(1, "a clean text", None), (2, "another one", None)], "doc_id long, text string, lang string")
    assert langid.keep_identified(docs, langid.fit(docs)).count() == 2


def test_language_beyond_the_64th(spark):
    rows = [(100 * k + j, " ".join([chr(0x4E00 + 40 * k + j % 3) + chr(0x4E20 + 40 * k)] * 8), f"x{k:02}") for k in range(66) for j in range(6 if k < 65 else 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs, per_language=4)
    assert sum(model.by_family.values(), []) == [f"x{k:02}" for k in range(66)]
    got = [r["lang_pred"] for r in langid.identify(docs.where("lang = 'x65'"), model).collect()]
    assert got == ["x65"] * 5


def test_lost_duel_counts():
    names = [("lang", x) for x in "abc"]
    margin = {(names[0], names[1]): [2.0], (names[0], names[2]): [-0.5], (names[1], names[2]): [1.0]}  # each wins once
    assert langid.Model._duel(names, margin, 0) == ("a", -0.5)


def test_run_and_empty(spark, sf):
    got = corpus_pipeline.run(spark, sf)
    assert got.count() > 0 and got.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    empty = common.table(spark, sf, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty = common.written(stage(spark, empty, sf))
    assert empty.count() == 0


def test_segments_hold_all_ids(spark, sf):
    docs = common.table(spark, sf, "documents")
    segments = token_codes.write_codes(docs, corpus_pipeline.tokenizer_path())
    total = sum(token_codes.Segment(bytes(r[0])).n_ids for r in segments.select("segment").collect())
    assert total == sum(r["n_tokens"] for r in token_codes.read_codes(segments).collect())
