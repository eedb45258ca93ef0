import shutil

from loomgraph.streaming import logs


def test_stream_equals_batch(spark, sf, tmp_path):
    (tmp_path / "in").mkdir()
    shutil.copy(f"{sf}/events.parquet", tmp_path / "in" / "events.parquet")
    batch = spark.read.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in"))
    for name, f in (("w", logs.windowed_usage), ("s", logs.sessions)):
        q = f(stream).writeStream.format("memory").queryName(f"out_{name}").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / name)).start()
        q.awaitTermination()
        got = spark.table(f"out_{name}").select("start", "n").collect()
        want = {(r["start"], r["n"]) for r in f(batch).select("start", "n").collect()}
        assert got and {(r["start"], r["n"]) for r in got} <= want
