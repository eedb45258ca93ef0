"""License scans by diagonal voting.

All rolling three-word hashes of a text are joined to the positions that have
them in a small table of templates.  A hit votes for the diagonal (text
position - template position); neighbouring diagonals of one template, shifted
by inserted or missing words, merge; and a span counts when its votes cover
enough of the template.  A phrase of the base list must lie whole on one
diagonal.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import row_key, words, written

GRAM = 3
#: Share of a template's words that a span must cover, diagonals apart that still merge, and length against the template.
LEAST_COVER, NEAR, LONGEST = 0.7, 3, 1.5
# Base phrases and labels.
PHRASES = [("mit", "under the mit license"), ("apache-2", "apache license version 2"), ("cc-by-nc", "cc by nc")]
# Opening sentences and notices of public licenses.
TEMPLATES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("gpl-3", "this work is licensed under the gnu general public license version 3"),
    ("gpl-3", "gnu general public license as published by the free software foundation either version 3 of the license"),
    ("gpl-2", "gnu general public license as published by the free software foundation either version 2 of the license"),
    ("lgpl", "gnu lesser general public license as published by the free software foundation"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
]


def template_grams(spark: SparkSession) -> DataFrame:
    """(t_id, t_label, t_base, t_size, t_at, t_words, t_hash): a few hundred rows, fixed."""
    rows = [(k, label, k < len(PHRASES), text) for k, (label, text) in enumerate(PHRASES + TEMPLATES)]
    t = spark.createDataFrame(rows, "t_id int, t_label string, t_base boolean, text string").withColumn("w", words(F.col("text")))
    t = t.select("t_id", "t_label", "t_base", F.size("w").alias("t_size"), "w", F.posexplode("w").alias("t_at", "x")).where(F.col("t_at") + GRAM <= F.col("t_size"))
    t_words = F.slice("w", F.col("t_at") + 1, GRAM)
    return t.select("t_id", "t_label", "t_base", "t_size", "t_at", t_words.alias("t_words"), F.xxhash64(*[F.get("w", F.col("t_at") + i) for i in range(GRAM)]).alias("t_hash"))


def spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(k1, k2, label, base, at, words, cover) of every verified span, by the row's key; ``at`` counts words from 0."""
    k1, k2 = row_key(docs, id_col, text_col)
    scan = docs.select(k1.alias("k1"), k2.alias("k2"), words(docs[text_col]).alias("w"))
    grams = scan.select("k1", "k2", "w", F.posexplode("w").alias("at", "x")).where(F.col("at") + GRAM <= F.size("w"))
    grams = grams.select("k1", "k2", "w", "at", F.xxhash64("x", *[F.get("w", F.col("at") + i) for i in range(1, GRAM)]).alias("h"))
    side = F.broadcast(template_grams(docs.sparkSession))
    votes = grams.join(side, (F.col("h") == F.col("t_hash")) & (F.slice(F.col("w"), F.col("at") + 1, F.lit(GRAM)) == F.col("t_words")))
    votes = votes.select("k1", "k2", "t_id", "t_label", "t_base", "t_size", "t_at", "at", (F.col("at") - F.col("t_at")).alias("diagonal")).distinct()
    lines = votes.groupBy("k1", "k2", "t_id", "t_label", "t_base", "t_size", "diagonal").agg(F.collect_set("t_at").alias("hits"), F.min("at").alias("at"), (F.max("at") + GRAM).alias("end"))
    lines = written(lines)  # both uses below would scan all texts
    whole = lines.where("t_base").where(F.size("hits") == F.col("t_size") - (GRAM - 1)).select("k1", "k2", F.col("t_label").alias("label"), F.lit(True).alias("base"), "at", F.col("t_size").alias("words"), F.lit(1.0).alias("cover"))
    by = W.partitionBy("k1", "k2", "t_id").orderBy("diagonal")
    apart = (F.col("diagonal") - F.lag("diagonal").over(by) > NEAR).cast("int")
    near = lines.where("not t_base").withColumn("new", F.coalesce(apart, F.lit(0))).withColumn("run", F.sum("new").over(by))
    merged = near.groupBy("k1", "k2", "t_id", "t_label", "t_size", "run").agg(F.array_distinct(F.flatten(F.collect_list("hits"))).alias("hits"), F.min("at").alias("at"), F.max("end").alias("end"))
    covered = F.size(F.array_distinct(F.flatten(F.transform("hits", lambda i: F.sequence(i, i + GRAM - 1)))))
    merged = merged.withColumn("cover", covered / F.col("t_size")).withColumn("words", F.col("end") - F.col("at"))
    found = merged.where((F.col("cover") >= LEAST_COVER) & (F.col("words") <= LONGEST * F.col("t_size") + GRAM))
    return whole.union(found.select("k1", "k2", F.col("t_label").alias("label"), F.lit(False).alias("base"), "at", "words", "cover"))


def licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, n_words, base places and labels, all labels, score (best cover, 0 without a span).

    Null and empty texts have no words; repeated rows repeat; an empty table gives no rows; texts of any length are read whole;
    other columns are ignored.
    """
    k1, k2 = row_key(docs, id_col, text_col)
    found = spans(docs, id_col, text_col).groupBy("k1", "k2").agg(
        F.sum(F.col("base").cast("long")).alias("n_base"), F.min(F.when(F.col("base"), F.col("at"))).cast("long").alias("first_word"), F.max(F.when(F.col("base"), F.col("at"))).cast("long").alias("last_word"),
        F.collect_set(F.when(F.col("base"), F.col("label"))).alias("b"), F.collect_set("label").alias("l"), F.max("cover").alias("score"))
    none = F.array().cast("array<string>")
    names = lambda c: F.array_join(F.array_sort(F.coalesce(F.col(c), none)), ",")
    n_words = F.size(words(docs[text_col])).cast("long")
    base = docs.select(docs[id_col], k1.alias("k1"), k2.alias("k2"), n_words.alias("n_words"))
    out = base.join(found, ["k1", "k2"], "left")
    return out.select(id_col, "n_words", F.coalesce("n_base", F.lit(0)).alias("n_base"), "first_word", "last_word", names("b").alias("base_labels"), names("l").alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"))
