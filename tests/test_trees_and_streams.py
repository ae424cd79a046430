from datetime import datetime, timedelta

from pyspark.sql import functions as F

from larkspur.operators import diagnostics, plantree
from larkspur.streaming import feeds

TASKS = [("p", "1", "", "pending", True), ("p", "1.1", "1", "completed", False), ("p", "1.2", "1", "failed", False), ("p", "2", "", "in_progress", False), ("p", "2.1", "2", "pending", False), ("p", "10", "", "completed", False)]


def tasks(spark):
    return spark.createDataFrame(TASKS, "plan_id string, path string, parent string, status string, checkpoint boolean")


def test_rollups(spark):
    t = tasks(spark)
    assert tuple(plantree.progress(t).first()) == ("p", 6, 2, 0.3333)
    assert {r.path: r.status for r in plantree.promote(t).collect()}["1"] == "failed"
    assert plantree.current_task(t).first().path == "2"
    done = t.withColumn("status", F.when(F.col("path") == "1.2", "cancelled").otherwise(F.col("status")))
    assert [r.path for r in plantree.pending_checkpoints(done, t.limit(0)).collect()] == ["1"] and plantree.pending_checkpoints(t, t.limit(0)).count() == 0
    assert {r.path for r in plantree.completed_path(t).collect()} == {"10"}
    got = {r.path: r.status for r in plantree.cancel(t, t.where("path = '1'")).collect()}
    assert got["1"] == got["1.2"] == "cancelled" and got["1.1"] == "completed" and got["10"] == "completed"
    parents = spark.createDataFrame([("p", ""), ("p", "1"), ("p", "10")], "plan_id string, path string")
    assert {r.path: r.child for r in plantree.next_ids(t, parents).collect()} == {"": "11", "1": "1.3", "10": "10.1"}
    ups = spark.createDataFrame([("p", "2", 1, "blocked"), ("p", "2", 2, "completed"), ("p", "9", 1, "x")], "plan_id string, path string, seq int, status string")
    assert {r.path: r.status for r in plantree.apply_updates(t, ups).collect()}["2"] == "completed"


def test_replace_by_key(spark):
    schema = "uri string, version int, message string"
    state = spark.createDataFrame([("a", 1, "old"), ("b", 1, "old"), ("c", 1, "old")], schema)
    feed = spark.createDataFrame([("a", 2, "x"), ("a", 3, "y"), ("a", 3, "z"), ("b", 2, None)], schema)
    assert {tuple(r) for r in diagnostics.replace_by_key(state, feed).collect()} == {("a", 3, "y"), ("a", 3, "z"), ("c", 1, "old")}


def run(spark, frames, tmp_path, make):
    """Batches as files, read one a trigger; the rows that come out."""
    src = tmp_path / "in"
    for i, f in enumerate(frames):
        f.coalesce(1).write.mode("append").parquet(str(src))
    stream = spark.readStream.schema(frames[0].schema).option("maxFilesPerTrigger", 1).parquet(str(src))
    name = "out_" + tmp_path.name.replace("-", "_")
    q = make(stream).writeStream.outputMode("append").format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    return spark.sql(f"select * from {name}").collect()


def test_thinning_stream_equals_batch(spark, tmp_path):
    from larkspur.operators import timeline

    t0 = datetime(2024, 1, 1)
    rows = [(i, "ab"[i % 2], t0 + timedelta(seconds=7 * i)) for i in range(120)]
    df = spark.createDataFrame(rows, "id int, k string, ts timestamp")
    want = {r.id for r in timeline.thin(df.withColumn("us", timeline.micros(F.col("ts"))).drop("ts"), "k", "us", "id", 60_000_000).collect()}
    got = {r.id for r in run(spark, [df.where("id < 60"), df.where("id >= 60")], tmp_path, lambda s: feeds.thin_stream(s, "k", "ts", 60.0))}
    assert got == want


def test_upsert_feed(spark, tmp_path):
    schema = "uri string, version int, message string"
    src = tmp_path / "in"
    for i, rows in enumerate([[("a", 1, "x"), ("b", 1, "y")], [("a", 2, None), ("b", 2, "z")]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(src))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(src))
    q = feeds.upsert_feed(stream, str(tmp_path / "t"), str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert [tuple(r) for r in spark.read.parquet(str(tmp_path / "t" / "v1")).collect()] == [("b", 2, "z")]
