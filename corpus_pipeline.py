"""A corpus pipeline over ``documents``: five stages, each written as Parquet and read again by the next.

1. language_id: drops documents without a letter or below the least score.
2. near_duplicates: of each component of the five-word-shingle Jaccard join (0.75), the document of smallest id stays.
3. decontaminate: drops documents that hold a ten-word window of a benchmark item.
4. mix: repeats or drops documents by Poisson counts so that all sources weigh the same, in global random order.
5. token_codes: writes all token ids as directly addressable codes and reports them from the files.

SQL can't express stages 1, 2 and 5; tests compare them with brute-force versions.

Null, empty and wordless texts go in stage 1, which finds no letter in them; a null language or source is a value like others,
a null id counts as "" where it is hashed and is never a component's smallest. Equal rows share their fate in stages 1 and 3;
stage 2 keeps one of them. Texts of any length are read whole. An empty table stays empty through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomgraph.llm import decontaminate, langid, mixing, ngram_join, token_codes
from loomgraph.llm.common import table, written
from loomgraph.llm.queries import tokenizer_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.keep_identified(docs, langid.fit(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.one_of_each(docs)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs).select(*docs.columns)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return token_codes.read_codes(token_codes.write_codes(docs, tokenizer_path()))


STAGES = [("language_id", language_id), ("near_duplicates", near_duplicates), ("decontaminate", remove_benchmark), ("mix", mix_sources), ("token_codes", write_tokens)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; returns the last one's rows."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs)
    return docs
