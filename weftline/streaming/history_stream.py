"""Run events as streams: deduplicated outcomes, atomic bundles, isolated sinks, settled changes, bursts and flushes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def outcomes(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """One outcome for each (run, task) of a stream with an event-time column `at`; late repeats are dropped."""
    return events.withWatermark("at", delay).dropDuplicatesWithinWatermark(["run_id", "task_id"])


def _landed(batch: DataFrame, path: str) -> DataFrame:
    """batch as a table, read back instead of cached: a lost executor costs nothing."""
    batch.write.mode("overwrite").parquet(path)
    return batch.sparkSession.read.schema(batch.schema).parquet(path)


def write_bundles(stream: DataFrame, root: str, checkpoint: str, interval: str = "10 seconds"):
    """Each micro-batch lands as one bundle: rows, headers and durations under its batch id, then its commit record.

    Readers join the commit records (bundles()), so a bundle is seen whole or
    not at all. A batch that is repeated after a failure overwrites its own
    parts and its record.
    """

    def land(batch: DataFrame, batch_id: int) -> None:
        rows = _landed(batch, f"{root}/runs/batch={batch_id}")
        head = rows.groupBy("run_id").agg(F.count("*").alias("task_count"), F.count(F.when(F.col("status") == "failed", 1)).alias("failed_count"))
        head.write.mode("overwrite").parquet(f"{root}/invocations/batch={batch_id}")
        rows.where("status = 'success'").select("id", "project", "task", "duration_ms").write.mode("overwrite").parquet(f"{root}/task_durations/batch={batch_id}")
        # last: what makes the three visible
        rows.agg(F.count("*").alias("rows")).coalesce(1).write.mode("overwrite").parquet(f"{root}/commits/batch={batch_id}")

    return stream.writeStream.foreachBatch(land).option("checkpointLocation", checkpoint).trigger(processingTime=interval)


def bundles(spark: SparkSession, root: str, part: str) -> DataFrame:
    """The rows of one part (runs, invocations, task_durations) of all bundles that are committed.

    The headers of a run whose rows came in several bundles are added up.
    """
    committed = spark.read.schema("rows long, batch long").parquet(f"{root}/commits").select("batch").distinct()
    rows = spark.read.parquet(f"{root}/{part}").join(committed, "batch", "left_semi").drop("batch")
    if part != "invocations":
        return rows
    return rows.groupBy("run_id").agg(F.sum("task_count").alias("task_count"), F.sum("failed_count").alias("failed_count"))


def fan_out(stream: DataFrame, sinks: dict[str, Callable[[DataFrame, int], None]], root: str, checkpoint: str):
    """One stream to several sinks, each called with (rows, batch_id), in order and by itself.

    A sink that fails neither stops the stream nor keeps a later sink from its
    rows: the failure is one row of deliveries(). Every sink reads the same
    landed rows. When a batch is repeated after a crash, sinks that took it
    are not called again.
    """

    def land(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows, done_at = _landed(batch, f"{root}/events/batch={batch_id}"), f"{root}/deliveries/batch={batch_id}"
        for name, sink in sinks.items():
            if _exists(spark, f"{done_at}/sink={name}/_SUCCESS"):
                continue
            error = None
            try:
                sink(rows, batch_id)
            except Exception as e:  # noqa: BLE001
                error = f"{type(e).__name__}: {e}".splitlines()[0]
            rows.agg(F.count("*").alias("rows")).select("rows", F.lit(error).cast("string").alias("error")).coalesce(1).write.mode("overwrite").parquet(f"{done_at}/sink={name}")

    return stream.writeStream.foreachBatch(land).option("checkpointLocation", checkpoint)


def deliveries(spark: SparkSession, root: str) -> DataFrame:
    """(rows, error, batch, sink): what each sink of a fan-out was given; error is null where it took it."""
    return spark.read.schema("rows long, error string, batch long, sink string").parquet(f"{root}/deliveries")


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def settled_changes(stream: DataFrame) -> DataFrame:
    """(key, id, state) rows whose state differs from the one last seen of the key.

    The rows of a key in one micro-batch are put in order together, however
    many Arrow batches they come in.
    """

    def run(key, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(parts)).sort_values("id", kind="stable")
        before = rows["state"].shift()
        if state.exists:
            before.iloc[0] = state.get[0]
        # None is a state like any other
        keep = ~((rows["state"] == before) | (rows["state"].isna() & before.isna()))
        keep.iloc[0] |= not state.exists
        last = rows["state"].iloc[-1]
        state.update((None if pd.isna(last) else last,))
        yield rows[keep][["key", "id", "state"]]

    return stream.groupBy("key").applyInPandasWithState(run, "key string, id long, state string", "last string", "append", GroupStateTimeout.NoTimeout)


class Cuts:
    """Where the times of a key are cut into groups, in order of time.

    A time opens a new group when it lies more than gap_ms after the last,
    more than most_ms after the first of the open group, or that group has
    most_n times. No bound: None.
    """

    def __init__(self, gap_ms: int | None = None, most_ms: int | None = None, most_n: int | None = None):
        self.gap = FOREVER if gap_ms is None else gap_ms
        self.most = FOREVER if most_ms is None else most_ms
        self.n = FOREVER if most_n is None else most_n

    def fold(self, times: list[int], open_: tuple | None, upto: int) -> tuple[list[tuple], tuple | None]:
        """(closed groups, open group) as (first, last, n), after ordered times; upto: no earlier time can come any more."""
        done = []
        for at in times:
            if open_ is None:
                open_ = (at, at, 1)
            elif at - open_[1] > self.gap or at - open_[0] > self.most or open_[2] >= self.n:
                done.append(open_)
                open_ = (at, at, 1)
            else:
                open_ = (open_[0], at, open_[2] + 1)
        if open_ is not None and upto > self.deadline(open_):
            done.append(open_)
            open_ = None
        return done, open_

    def deadline(self, open_: tuple) -> int:
        """The last time that can still join the open group."""
        return -1 if open_[2] >= self.n else min(open_[1] + self.gap, open_[0] + self.most)


FOREVER = 1 << 61
_GROUP = "key string, first_at long, last_at long, n long"
_STATE = "waiting binary, first_at long, last_at long, n long"


def grouped_in_time(changes: DataFrame, cuts: Cuts, delay: str = "1 hour") -> DataFrame:
    """(key, first_at, last_at, n): the times `at` (milliseconds) of each key in groups by cuts.

    session_window has the gap but neither the longest time nor the count, so
    the open group is state. Times wait in the state until the watermark has
    passed them, and are folded in order then, whatever the order of files and
    Arrow batches; a timer closes a group that nothing can join any more. What
    comes later than `delay` is dropped, as with any watermark, and so is what
    lies before 1970, where a stream's first watermark is. At the end of a
    drain still_open() has what no watermark has passed.
    """

    def run(key, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        waiting, open_ = np.empty(0, np.int64), None
        if state.exists:
            raw, *rest = state.get
            waiting, open_ = np.frombuffer(raw, np.int64), tuple(rest) if rest[2] else None
        now = state.getCurrentWatermarkMs()
        waiting = np.sort(np.concatenate([waiting, *(part["at"].to_numpy(np.int64) for part in parts)]))
        passed = int(np.searchsorted(waiting, now))
        done, open_ = cuts.fold(waiting[:passed].tolist(), open_, now)
        waiting = waiting[passed:]
        if len(waiting) or open_:
            state.update((waiting.tobytes(), *(open_ or (0, 0, 0))))
            wake = min([int(waiting[0])] if len(waiting) else [cuts.deadline(open_)])
            state.setTimeoutTimestamp(max(wake, now) + 1)
        elif state.exists:
            state.remove()
        yield pd.DataFrame([(key[0], *g) for g in done], columns=["key", "first_at", "last_at", "n"])

    timed = changes.select("key", "at", F.timestamp_millis("at").alias("_at")).withWatermark("_at", delay)
    return timed.groupBy("key").applyInPandasWithState(run, _GROUP, _STATE, "append", GroupStateTimeout.EventTimeTimeout)


def still_open(spark: SparkSession, checkpoint: str, cuts: Cuts) -> DataFrame:
    """The groups that the state of a drained grouped_in_time() holds: waiting times folded, the open group closed."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for r in part.itertuples(index=False):
                done, _ = cuts.fold(np.sort(np.frombuffer(r.waiting, np.int64)).tolist(), (r.first_at, r.last_at, r.n) if r.n else None, 2 * FOREVER)
                out += [(r.key, *g) for g in done]
            yield pd.DataFrame(out, columns=["key", "first_at", "last_at", "n"])

    held = spark.read.format("statestore").load(checkpoint).where("value.groupState.waiting IS NOT NULL")
    return held.select("key.key", "value.groupState.*").mapInPandas(run, _GROUP)


def bursts(changes: DataFrame, gap_ms: int = 150, most_ms: int = 1000, delay: str = "1 hour") -> DataFrame:
    """(key, first_at, last_at, n) of bursts: changes closer than gap_ms, cut most_ms after the first."""
    return grouped_in_time(changes, Cuts(gap_ms, most_ms), delay)


def flushes(finished: DataFrame, most_n: int = 50, most_ms: int = 10_000, delay: str = "1 hour") -> DataFrame:
    """(key, first_at, last_at, n) of uploads: a finished task waits until most_n are there, or most_ms after the first."""
    return grouped_in_time(finished, Cuts(None, most_ms, most_n), delay)


def windowed_counts(events: DataFrame, delay: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Failures and rows of each window and project, once the watermark has passed."""
    w = events.withWatermark("at", delay).groupBy(F.window("at", width), "project")
    return w.agg(F.count("*").alias("n"), F.count(F.when(F.col("status") == "failed", 1)).alias("failed"))


def read_events(spark: SparkSession, path: str, schema, files_per_batch: int = 8) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)
