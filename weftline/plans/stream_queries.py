"""Streaming operators over the run history, drained to the end of what there is."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.bindings import Tables
from ..sources.shared import shared_folder
from ..streaming import history_stream as HS
from .registry import query


class Streamed(Tables):
    """The relations with the events as a stream."""

    def table(self, name: str) -> DataFrame:
        if name != "events":
            return super().table(name)
        # as a pattern: a stream takes a plain path for a folder, and a table may be one file
        return self.spark.readStream.schema(super().table(name).schema).parquet(f"{self.sf_dir}/{name}.parque[t]")


def _drained(t: Tables, stream: DataFrame, land) -> str:
    """Runs the stream to the end of its input; land(stream, folder, checkpoint) writes it."""
    root = shared_folder(t.spark)
    land(stream, f"{root}/out", f"{root}/check").trigger(availableNow=True).start().awaitTermination()
    return f"{root}/out"


def _bundles(t: Tables) -> str:
    return _drained(t, Streamed(t.spark, t.sf_dir).runs, HS.write_bundles)


@query("K1_run_bundles", "SELECT i.run_id, i.task_count, i.failed_count, count(d.id) AS timings FROM invocations i JOIN runs r ON r.run_id = i.run_id LEFT JOIN task_durations d ON d.id = r.id GROUP BY ALL")
def k1(t):
    root = _bundles(t)
    part = lambda name: HS.bundles(t.spark, root, name)
    timed = part("runs").select("id", "run_id").join(part("task_durations").select("id"), "id").groupBy("run_id").agg(F.count("*").alias("timings"))
    return part("invocations").join(timed, "run_id", "left").fillna(0, ["timings"])


@query("R3_incremental_landing", "SELECT id, run_id, project, task, status FROM runs")
def r3(t):
    return HS.bundles(t.spark, _bundles(t), "runs").select("id", "run_id", "project", "task", "status")


def _cut_times(key: str, cut: str) -> str:
    """SQL that folds the times of each key one by one; cut: when a time opens a new group."""
    return f"""WITH RECURSIVE e AS (SELECT {key} AS key, started_at AS ts, row_number() OVER (PARTITION BY {key} ORDER BY started_at) AS k FROM runs),
        f AS (SELECT key, k, ts, ts AS first_at, 1::BIGINT AS n FROM e WHERE k = 1
              UNION ALL SELECT e.key, e.k, e.ts, CASE WHEN {cut} THEN e.ts ELSE f.first_at END, CASE WHEN {cut} THEN 1 ELSE f.n + 1 END FROM f JOIN e ON e.key = f.key AND e.k = f.k + 1)"""


def _all_groups(t: Tables, key: str, cuts: HS.Cuts) -> DataFrame:
    """What a drained stream of each key's times has closed, and what its state still holds."""
    stream = Streamed(t.spark, t.sf_dir).runs.select(F.col(key).alias("key"), F.col("started_at").alias("at"))
    land = lambda s, out, check: HS.grouped_in_time(s, cuts).writeStream.format("parquet").option("path", out).option("checkpointLocation", check)
    root = _drained(t, stream, land)
    closed = t.spark.read.schema("key string, first_at long, last_at long, n long").parquet(root)
    return closed.unionByName(HS.still_open(t.spark, root.removesuffix("/out") + "/check", cuts))


@query("R4_debounced_bursts", _cut_times("project", "e.ts - f.ts > 600000 OR e.ts - f.first_at > 3600000") + " SELECT key, first_at, max(ts) AS last_at, count(*) AS n FROM f GROUP BY key, first_at")
def r4(t):
    return _all_groups(t, "project", HS.Cuts(600_000, 3_600_000))


# 50 tasks or four hours, whichever is first: the test tables hold some 14 tasks an hour at the least
@query("R3b_flushes", _cut_times("task", "f.n >= 50 OR e.ts - f.first_at > 14400000") + ", g AS (SELECT *, sum(CASE WHEN n = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY key ORDER BY k) AS place FROM f) SELECT key, min(ts) AS first_at, max(ts) AS last_at, count(*) AS n FROM g GROUP BY key, place")
def r3b(t):
    return _all_groups(t, "task", HS.Cuts(None, 14_400_000, 50))


@query(
    "R1_isolated_sinks",
    """SELECT 'counts' AS sink, status AS kind, count(*) AS n, 0 AS failed FROM runs GROUP BY status UNION ALL SELECT 'broken', NULL, count(*), 1 FROM runs
       UNION ALL SELECT 'longest', project, max(duration_ms), 0 FROM runs GROUP BY project""",
)
def r1(t):
    root = shared_folder(t.spark)

    def broken(rows, batch_id):
        raise RuntimeError("this sink takes nothing")

    def counts(rows, batch_id):
        rows.groupBy("status").agg(F.count("*").alias("n")).write.mode("overwrite").parquet(f"{root}/counts/batch={batch_id}")

    def longest(rows, batch_id):
        rows.groupBy("project").agg(F.max("duration_ms").alias("n")).write.mode("overwrite").parquet(f"{root}/longest/batch={batch_id}")

    stream = Streamed(t.spark, t.sf_dir).runs
    HS.fan_out(stream, {"counts": counts, "broken": broken, "longest": longest}, root, f"{root}/check").trigger(availableNow=True).start().awaitTermination()
    made = lambda sink, kind, total: t.spark.read.parquet(f"{root}/{sink}").groupBy(F.col(kind).alias("kind")).agg(total("n").alias("n")).select(F.lit(sink).alias("sink"), "kind", "n", F.lit(0).alias("failed"))
    refused = HS.deliveries(t.spark, root).where("error IS NOT NULL").groupBy("sink").agg(F.sum("rows").alias("n")).select("sink", F.lit(None).cast("string").alias("kind"), "n", F.lit(1).alias("failed"))
    return made("counts", "status", F.sum).unionByName(made("longest", "project", F.max)).unionByName(refused)
