from collections import Counter

from tokenizers import Tokenizer

from loomgraph.llm import common, queries, token_counts


def test_suffix_sums(spark, sf, monkeypatch):
    monkeypatch.setattr(token_counts, "BUCKET", 7)
    path = queries.tokenizer_path()
    tok = Tokenizer.from_file(path)
    docs = common.table(spark, sf, "documents").select("text").union(spark.createDataFrame([(None,), ("",), ("a b",), ("a b",)], "text string"))
    lengths = [len(tok.encode(r["text"] or "", add_special_tokens=False).ids) for r in docs.collect()]
    sums = token_counts.suffix_sums(token_counts.histogram(docs, path))
    got = {r["n_tokens"]: r for r in sums.collect()}
    assert {n: r["n_docs"] for n, r in got.items()} == dict(Counter(lengths))
    for n, r in got.items():
        assert r["docs_at_least"] == sum(x >= n for x in lengths) and r["tokens_at_least"] == sum(x for x in lengths if x >= n)
        assert r["truncated_total"] == sum(min(x, n) for x in lengths) and abs(r["share_up_to"] - sum(x <= n for x in lengths) / len(lengths)) < 1e-12
    assert token_counts.quantile(sums, 0.5) == sorted(lengths)[(len(lengths) + 1) // 2 - 1]
    assert token_counts.truncated(sums, 100) == sum(min(x, 100) for x in lengths)
    none = token_counts.suffix_sums(token_counts.histogram(docs.limit(0), path))
    assert none.count() == 0 and token_counts.quantile(none, 0.5) is None and token_counts.truncated(none, 5) == 0


def test_odd_texts_and_names(spark):
    """Null, empty, repeated and very long texts, with other columns named as the operator's own."""
    path = queries.tokenizer_path()
    tok = Tokenizer.from_file(path)
    texts = [None, "", "a b", "a b", "word " * 200_000, "x" * 100_000, "😀 é\u2028 <|endoftext|>"]
    docs = spark.createDataFrame([(t, 5, "z", 1, 2) for t in texts], "text string, n_tokens int, n_docs string, b0 int, d int")
    want = Counter(len(tok.encode(t or "", add_special_tokens=False).ids) for t in texts)
    assert {r["n_tokens"]: r["n_docs"] for r in token_counts.histogram(docs, path).collect()} == dict(want)
