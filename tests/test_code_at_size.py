"""Code queries at size: files are parsed in all tasks, and once a query."""

import pytest
from pyspark.sql import functions as F

from loomgraph.operators import enrich as E
from loomgraph.operators import resolve as R
from loomgraph.plans import code_queries as Q
from loomgraph.sources import extract as X

PARSES = "MapInArrow", "MapInPandas"


def _parses(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return sum(plan.count(p) for p in PARSES)


@pytest.mark.parametrize("name", ["code_symbols", "code_imports", "code_attribute_types", "code_control_flow"])
def test_files_of_a_small_table_are_parsed_in_all_tasks(spark, sf, name):  # F5, F7, F8, F9: one task
    assert Q.QUERIES[name](spark, sf).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_a_graph_parses_each_file_once(spark):  # once a tier
    parsed = spark.sparkContext.accumulator(0)

    def tell(batches):
        for b in batches:
            parsed.add(b.num_rows)
            yield b

    files = spark.createDataFrame([(f"a{k}.py", f"def f{k}():\n    g{k}()\n\ndef g{k}():\n    return 1\n") for k in range(4)], "path string, text string")
    rows = X.extract(files).mapInArrow(tell, X.extract(files).schema)
    assert R.graph_of(rows)[1].where("relationship = 'INVOKES'").count() == 4
    assert parsed.value == X.extract(files).count()


@pytest.mark.parametrize("name", ["code_inheritance", "code_file_imports", "code_calls_after_update"])
def test_rows_that_are_asked_twice_are_parsed_once(spark, sf, name):  # parsed for each side of a join
    assert _parses(Q.QUERIES[name](spark, sf)) == 0  # all parsing was done when the rows were written


def test_extraction_gives_only_the_kinds_of_rows_asked_for(spark):  # texts of functions and patterns were written too
    files = spark.createDataFrame([("a.py", "import os\n\ndef f():\n    if 1:\n        g()\n")], "path string, text string")
    every = X.extract(files).groupBy("row").count().toPandas().set_index("row")["count"].to_dict()
    assert every == {"node": 2, "edge": 2, "import": 1, "pattern": 1}
    assert {r["row"] for r in X.extract(files, "edge", "import").select("row").collect()} == {"edge", "import"}
    assert "code" in Q._UNASKED and "semantic_kind" in Q._UNASKED


def test_descriptions_stay_in_their_rows(spark):  # a join by id parsed twice and multiplied equal ids
    nodes = spark.createDataFrame([("a", "load_x", "def load_x():\n    return 1"), ("a", "save_y", "def save_y():\n    return 2"), ("b", "top", "")], "id string, name string, code string")
    nodes = nodes.select("*", F.lit("function").alias("kind"), F.lit("function").alias("type"), F.lit("").alias("summary"), F.lit(None).cast("string").alias("summary_source"))
    got = E.enrich(nodes)
    assert sorted((r.name, r.summary, r.summary_source) for r in got.collect()) == [("load_x", "Loads x.", "heuristic"), ("save_y", "Saves y.", "heuristic")]
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()


def test_every_function_has_a_description(spark, sf):  # only those named audit_ and load_ had one
    functions = X.extract(Q.files(spark, sf), "node").where("kind = 'function'").select("id")
    got = Q.code_descriptions(spark, sf)
    assert got.count() == functions.count() == got.join(functions, "id").where("summary <> ''").count()
