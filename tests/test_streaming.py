"""Streams against their batch forms."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from weftline.operators import timeline
from weftline.sources.bindings import Tables
from weftline.streaming import history_stream as HS


def drain(df, name, spark, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
    q.processAllAvailable()
    q.stop()
    return spark.table(name).collect()


def test_settled_changes_equal_the_batch(spark, sf, tmp_path):
    rows = Tables(spark, sf).runs.select(F.col("project").alias("key"), "id", F.col("status").alias("state"))
    for k in range(3):  # files in id order, one for each micro-batch
        rows.where(F.col("id") % 3000 >= 0).where((F.col("id") >= k * 400) & (F.col("id") < (k + 1) * 400)).coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    got = sorted((r.key, r.id, r.state) for r in drain(HS.settled_changes(stream), "settled", spark))
    want = sorted((r.key, r.id, r.state) for r in timeline.settled_changes(rows.where("id < 1200")).collect())
    assert got == want and got


def drained(df, root, spark, cuts):
    """All groups of a drained stream: the closed ones, and what the state holds."""
    HS.grouped_in_time(df, cuts).writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/check").trigger(availableNow=True).start().awaitTermination()
    closed = spark.read.schema("key string, first_at long, last_at long, n long").parquet(f"{root}/out").collect()
    left = HS.still_open(spark, f"{root}/check", cuts).collect()
    return sorted((r.key, r.first_at, r.last_at, r.n) for r in closed), sorted((r.key, r.first_at, r.last_at, r.n) for r in left)


def plain_groups(times, gap, most, n):
    out, open_ = [], None
    for at in sorted(times):
        if open_ and at - open_[1] <= gap and at - open_[0] <= most and open_[2] < n:
            open_ = (open_[0], at, open_[2] + 1)
        else:
            out += [open_] if open_ else []
            open_ = (at, at, 1)
    return out + ([open_] if open_ else [])


def test_bursts(spark, tmp_path):
    # after the epoch: a stream's first watermark is there
    times = [1_000_000 + t for t in (0, 100, 200, 1000, 1100, 1200, 1300, 1400, 1500, 1600, 1700, 1800, 1900, 2000, 2050, 9000)]
    spark.createDataFrame([("a", t) for t in times], "key string, at long").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("key string, at long").parquet(str(tmp_path / "in"))
    closed, left = drained(stream, tmp_path, spark, HS.Cuts(150, 1000))
    # the last one too
    assert [(a - 1_000_000, b - 1_000_000, n) for _, a, b, n in sorted(closed + left)] == [(0, 200, 3), (1000, 2000, 11), (2050, 2050, 1), (9000, 9000, 1)]


def test_every_burst_comes_out_whatever_the_order_of_files_and_batches(spark, tmp_path):
    r = random.Random(5)
    hour = 3_600_000
    # hot keys, days apart from each other's rows, shuffled within two hours
    rows = [(k, int(1.7e12) + i * 40_000 + r.randrange(30_000)) for k in "abc" for i in range(1_500 if k == "a" else 60)]
    rows.sort(key=lambda x: x[1] + r.randrange(hour // 4))
    for k in range(6):
        part = rows[k * len(rows) // 6 : (k + 1) * len(rows) // 6]
        r.shuffle(part)
        spark.createDataFrame(part, "key string, at long").coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    stream = spark.readStream.schema("key string, at long").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        closed, left = drained(stream, tmp_path, spark, HS.Cuts(45_000, 400_000, 9))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    want = sorted((k, *g) for k in "abc" for g in plain_groups([t for x, t in rows if x == k], 45_000, 400_000, 9))
    assert sorted(closed + left) == want and closed and left and sum(g[3] for g in want) == len(rows)


def test_an_upload_goes_at_so_many_tasks_or_after_so_long(spark, tmp_path):
    times = [1_000_000 + t for t in (*range(0, 600, 10), 700, 9_000, 10_701, 10_702, 30_000)]
    spark.createDataFrame([("run", t) for t in times], "key string, at long").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("key string, at long").parquet(str(tmp_path / "in"))
    closed, left = drained(stream, tmp_path, spark, HS.Cuts(None, 10_000, 50))
    assert [(a - 1_000_000, b - 1_000_000, n) for _, a, b, n in sorted(closed + left)] == [(0, 490, 50), (500, 9_000, 12), (10_701, 10_702, 2), (30_000, 30_000, 1)]


def test_bundles_land_once(spark, sf, tmp_path):
    rows = Tables(spark, sf).runs
    rows.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    for _ in range(2):  # the second start has nothing left to do
        q = HS.write_bundles(stream, str(tmp_path / "out"), str(tmp_path / "check"), "0 seconds").start()
        q.processAllAvailable()
        q.stop()
    assert spark.read.parquet(str(tmp_path / "out/runs")).count() == rows.count()
    assert spark.read.parquet(str(tmp_path / "out/task_durations")).count() == rows.where("status = 'success'").count()
    assert spark.read.parquet(str(tmp_path / "out/invocations")).agg(F.sum("task_count")).first()[0] == rows.count()


def test_outcomes_are_told_once(spark, tmp_path):
    kind = "run_id string, task_id string, at timestamp"
    spark.sql("SELECT 'r' AS run_id, 't' AS task_id, timestamp'2024-01-01 00:00:00' AS at UNION ALL SELECT 'r', 't', timestamp'2024-01-01 00:01:00' UNION ALL SELECT 'r', 'u', timestamp'2024-01-01 00:00:00'").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(kind).parquet(str(tmp_path / "in"))
    assert len(drain(HS.outcomes(stream), "outcomes", spark)) == 2


def test_a_bundle_without_its_record_is_not_seen(spark, tmp_path):
    rows = spark.createDataFrame([(1, "r", "p", "t", "success", 5), (2, "r", "p", "t", "failed", 6), (3, "s", "p", "t", "success", 7)], "id long, run_id string, project string, task string, status string, duration_ms long")
    root = str(tmp_path / "out")
    for k in range(3):
        rows.where(f"id = {k + 1}").write.parquet(str(tmp_path / f"in/{k}"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    HS.write_bundles(stream, root, str(tmp_path / "check"), "0 seconds").trigger(availableNow=True).start().awaitTermination()
    heads = lambda: sorted((r.run_id, r.task_count, r.failed_count) for r in HS.bundles(spark, root, "invocations").collect())
    assert heads() == [("r", 2, 1), ("s", 1, 0)]
    # a writer that dies after its rows leaves nothing to be seen
    rows.write.parquet(f"{root}/runs/batch=9")
    rows.groupBy("run_id").agg(F.count("*").alias("task_count"), F.lit(0).cast("long").alias("failed_count")).write.parquet(f"{root}/invocations/batch=9")
    assert heads() == [("r", 2, 1), ("s", 1, 0)] and HS.bundles(spark, root, "runs").count() == 3 and HS.bundles(spark, root, "task_durations").count() == 2


def test_a_failing_sink_neither_stops_nor_repeats_the_others(spark, tmp_path):
    spark.range(10).coalesce(1).write.parquet(str(tmp_path / "in/a"))
    stream = lambda: spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    took, root = [], str(tmp_path / "out")

    def broken(rows, batch):
        took.append(("broken", batch))
        raise ValueError("no\nmore")

    def run(sinks):
        HS.fan_out(stream(), sinks, root, str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination()

    sinks = {"first": lambda rows, k: took.append(("first", k, rows.count())), "broken": broken, "last": lambda rows, k: took.append(("last", k, rows.count()))}
    run(sinks)
    spark.range(3).coalesce(1).write.parquet(str(tmp_path / "in/b"))
    run(sinks)
    assert took == [("first", 0, 10), ("broken", 0), ("last", 0, 10), ("first", 1, 3), ("broken", 1), ("last", 1, 3)]
    got = sorted((r.sink, r.batch, r.rows, r.error) for r in HS.deliveries(spark, root).collect())
    assert got == [("broken", 0, 10, "ValueError: no"), ("broken", 1, 3, "ValueError: no"), ("first", 0, 10, None), ("first", 1, 3, None), ("last", 0, 10, None), ("last", 1, 3, None)]


def test_states_settle_over_arrow_batches(spark, tmp_path):
    rows = [("a", i, "x" if i % 10 < 5 else "y") for i in range(60)] + [("a", 60, None), ("a", 61, None), ("b", 3, None), ("b", 4, "x")]
    random.Random(1).shuffle(rows)
    spark.createDataFrame(rows, "key string, id long, state string").coalesce(1).write.parquet(str(tmp_path / "in"))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    try:
        got = drain(HS.settled_changes(spark.readStream.schema("key string, id long, state string").parquet(str(tmp_path / "in"))), "settled_batches", spark)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    want = [("a", i, "x" if i % 10 < 5 else "y") for i in range(0, 60, 5)] + [("a", 60, None), ("b", 3, None), ("b", 4, "x")]
    assert sorted(map(str, ((r.key, r.id, r.state) for r in got))) == sorted(map(str, want))
