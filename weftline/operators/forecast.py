"""Duration forecasts and ordered folds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import measures as M
from . import stats as S
from .timeline import newest_per_task, running_in_cells


def tiered(durations: DataFrame, branch: str) -> DataFrame:
    """Per task: median of the last five on the branch, else the newest remote one, else of the last five anywhere.

    slow is the longest of the rows that the median was taken of.
    """

    def tier(rows: DataFrame, k: int, name: str) -> DataFrame:
        top = newest_per_task(rows, k, "project", "task")
        return top.groupBy("project", "task").agg(M.nearest_rank(F.col("duration_ms"), 0.5).alias(f"{name}_p50"), F.max("duration_ms").alias(f"{name}_slow"))

    any_ = tier(durations, 5, "any")
    own = tier(durations.where(F.col("source") == branch), 5, "own")
    remote = tier(durations.where("source = 'remote'"), 1, "remote")
    j = any_.join(own, ["project", "task"], "left").join(remote, ["project", "task"], "left")
    from_ = F.when(F.col("own_p50").isNotNull(), "branch").when(F.col("remote_p50").isNotNull(), "remote").otherwise("any")
    return j.select("project", "task", F.coalesce("own_p50", "remote_p50", "any_p50").alias("expected_ms"), F.coalesce("own_slow", "remote_slow", "any_slow").alias("slow_ms"), from_.alias("tier"))


def folded(reports: DataFrame, *keys: str) -> DataFrame:
    """Per key, in id order: EWMA of durations (weight 0.3), decayed maximum (0.9), and how many reports counted.

    A report within 5 % of the average changes nothing. A key's reports are
    sorted within its partition and streamed: only the fold's state is held.
    """
    rows = reports.select(*keys, "id", F.col("duration_ms").cast("double").alias("d"))
    schema = T.StructType([*rows.select(*keys).schema, T.StructField("ewma", T.DoubleType()), T.StructField("slow", T.DoubleType()), T.StructField("counted", T.LongType())])

    def step(ewma, slow, n, d):
        if ewma is not None and d is not None and abs(d - ewma) <= ewma * 0.05:
            return ewma, slow, n
        mean = d if ewma is None else None if d is None else ewma * 0.7 + d * 0.3
        return mean, slow * 0.9 if d is None else max(d, slow * 0.9), n + 1

    def run(parts):
        import pyarrow as pa

        at, state, types = None, (None, 0.0, 0), None
        made = lambda out: pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*out, strict=True), types, strict=True)], schema.names)
        for part in parts:
            types = [*(part.schema.field(k).type for k in keys), pa.float64(), pa.float64(), pa.int64()]
            out = []
            for *key, d in zip(*(part.column(c).to_pylist() for c in (*keys, "d")), strict=True):
                if key != at:
                    if at is not None:
                        out.append((*at, *state))
                    at, state = key, (None, 0.0, 0)
                state = step(*state, d)
            if out:
                yield made(out)
        if at is not None:
            yield made([(*at, *state)])

    f = rows.repartition(*keys).sortWithinPartitions(*keys, "id", "d").mapInArrow(run, schema)
    return f.select(*keys, F.round("ewma", 3).alias("ewma"), F.round("slow", 3).alias("slow"), "counted")


def first_hits(runs: DataFrame) -> DataFrame:
    """The first hit of each key that has no own pass before it."""
    by = ["project", "task", "hash"]
    own = runs.where("hash <> '' AND status = 'success'").groupBy(*by).agg(F.min("id").alias("first_pass"))
    hits = runs.where("hash <> '' AND cache_hit").groupBy(*by).agg(F.min("id").alias("id"))
    return hits.join(own, by, "left").where(F.col("first_pass").isNull() | (F.col("id") < F.col("first_pass"))).select(*by, "id")


def resources(runs: DataFrame, entries: DataFrame, durations: DataFrame) -> DataFrame:
    """Per task: cores that it needs, peak memory, and the machine sizes that it filled.

    Cores are the mean need of its own runs; where none was measured, the
    newest imported need, and only then what its hits were produced with.
    Memory is the largest of its own and its hits'; a saturated size is
    measured here, else imported.
    """
    own = S.own_rows(runs).where("status = 'success'")
    measured = F.when((F.col("duration_ms") > 0) & F.col("cpu_ms").isNotNull(), M.need())
    own = own.groupBy("project", "task").agg(F.max("peak_rss").alias("own_rss"), F.avg(measured).alias("own"))
    newest = durations.where("source = 'remote' AND cpu_parallelism IS NOT NULL").groupBy("project", "task").agg(F.max_by("cpu_parallelism", "id").alias("imported"))
    j = runs.select("project", "task").distinct()
    for part in (own, newest, S.produced(runs, entries), S.saturated(runs).withColumnsRenamed({"cores": "saturated_cores", "memory": "saturated_memory"})):
        j = j.join(part, ["project", "task"], "left")
    source = F.when(F.col("own").isNotNull(), "own").when(F.col("imported").isNotNull(), "imported").when(F.col("hit_cpu").isNotNull(), "hit")
    return j.select("project", "task", F.coalesce("own", "imported", "hit_cpu").alias("need"), source.alias("need_from"), F.greatest("own_rss", "hit_rss").alias("peak_rss"), "saturated_cores", "saturated_memory")


#: Fixed values of the server's fold: weight of a report, decay of peaks, share that is noise, and a day.
WEIGHT, DECAY, NOISE, DAY = 0.3, 0.9, 0.05, 86_400_000


def _fold_one(row: tuple | None, d, cores, rss, at) -> tuple:
    """A timing (duration, cores, rss, slow, runs, updated) with one report folded in."""
    if row is None:
        return d, cores, rss, d, 1, at
    duration, c, r, slow, n, updated = row
    moved = abs(d - duration) > duration * NOISE or cores is not None and (c is None or abs(cores - c) > c * NOISE) or rss is not None and (r is None or rss > r) or at - updated >= DAY
    if not moved:
        return row
    c = c if cores is None else cores if c is None else c * (1 - WEIGHT) + cores * WEIGHT
    r = r if rss is None else rss if r is None else max(rss, int(r * DECAY))
    return int(duration * (1 - WEIGHT) + d * WEIGHT + 0.5), c, r, max(d, int(slow * DECAY)), n + 1, at


def server_fold(reports: DataFrame, *keys: str) -> DataFrame:
    """Per key the timing that its reports (duration_ms, cores, rss, at) leave, folded in the order of id.

    A report within 5 % of the timing, without a new memory peak, changes
    nothing unless the timing is a day old. A key's reports are sorted within
    its partition and streamed: only the timing is held.
    """
    rows = reports.select(*keys, F.col("duration_ms").cast("long").alias("d"), F.col("cores").cast("double").alias("c"), F.col("rss").cast("long").alias("r"), F.col("at").cast("long").alias("at"), "id")
    names = {"duration_ms": T.LongType(), "cores": T.DoubleType(), "rss": T.LongType(), "slow_ms": T.LongType(), "runs": T.LongType(), "updated_at": T.LongType()}
    schema = T.StructType([*rows.select(*keys).schema, *(T.StructField(n, k) for n, k in names.items())])

    def run(parts):
        import pyarrow as pa

        key_at, row, types = None, None, None
        made = lambda out: pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*out, strict=True), types, strict=True)], schema.names)
        for part in parts:
            types = [*(part.schema.field(k).type for k in keys), pa.int64(), pa.float64(), *[pa.int64()] * 4]
            out = []
            for *key, d, c, r, at in zip(*(part.column(x).to_pylist() for x in (*keys, "d", "c", "r", "at")), strict=True):
                if key != key_at:
                    if key_at is not None:
                        out.append((*key_at, *row))
                    key_at, row = key, None
                row = _fold_one(row, d, c, r, at)
            if out:
                yield made(out)
        if key_at is not None:
            yield made([(*key_at, *row)])

    return rows.repartition(*keys).sortWithinPartitions(*keys, "id").mapInArrow(run, schema)


def server_upsert(stored: DataFrame, reports: DataFrame, *keys: str) -> DataFrame:
    """stored timings with one report (d, c, r, at) for each key folded in by the same rules; unknown keys are added."""
    j = stored.join(reports, list(keys), "full")
    new, none = F.col("duration_ms").isNull(), F.col("d").isNull()
    moved = (
        (F.abs(F.col("d") - F.col("duration_ms")) > F.col("duration_ms") * NOISE) | (F.col("c").isNotNull() & (F.col("cores").isNull() | (F.abs(F.col("c") - F.col("cores")) > F.col("cores") * NOISE)))
        | (F.col("r").isNotNull() & (F.col("rss").isNull() | (F.col("r") > F.col("rss")))) | (F.col("at") - F.col("updated_at") >= DAY)
    )
    keep = none | ~F.coalesce(moved, F.lit(False)) & ~new
    pick = lambda name, first, folded: F.when(new, first).when(keep, F.col(name)).otherwise(folded).alias(name)
    mix = lambda a, b: F.col(a) * (1 - WEIGHT) + F.col(b) * WEIGHT
    faded = lambda name: (F.col(name) * DECAY).cast("long")
    return j.select(
        *keys, pick("duration_ms", F.col("d"), F.round(mix("duration_ms", "d")).cast("long")), pick("cores", F.col("c"), F.coalesce(mix("cores", "c"), "c", "cores")),
        pick("rss", F.col("r"), F.when(F.col("r").isNull(), F.col("rss")).otherwise(F.greatest("r", faded("rss")))), pick("slow_ms", F.col("d"), F.greatest("d", faded("slow_ms"))),
        pick("runs", F.lit(1).cast("long"), F.col("runs") + 1), pick("updated_at", F.col("at"), F.col("at")),
    )


def running_usage(samples: DataFrame, cell: int = 3_600_000) -> DataFrame:
    """Per sample (key, id, at, cpu_ms, rss): CPU that never falls, average cores since the first sample, peak memory so far."""
    first = samples.groupBy("key").agg(F.min("at").alias("t0"))
    s = running_in_cells(samples.select("key", "id", "at", "cpu_ms", "rss"), "at", ["key"], {}, {"was_cpu": F.col("cpu_ms"), "was_rss": F.col("rss")}, cell, "id").join(first, "key")
    s = s.select("key", "id", "at", "t0", F.greatest("was_cpu", "cpu_ms").alias("cpu"), F.greatest("was_rss", "rss").alias("peak"))
    return s.select("key", "id", "cpu", "peak", F.try_divide(F.col("cpu").cast("double"), (F.col("at") - F.col("t0")).cast("double")).alias("mean_cores"))


#: Rows that a forecast looks back on.
LOOK_BACK = 5


def tiered_measures(durations: DataFrame, branch: str, current: DataFrame | None = None, imported: DataFrame | None = None, runs: int = LOOK_BACK) -> DataFrame:
    """(project, task, tier, duration_ms, cores, slow_ms) of the first tier that has rows of the task.

    durations: (id, project, task, source, duration_ms, cores, def). own is the
    newest few rows of the branch, remote the newest imported row, any the
    newest few of all branches. duration_ms and cores are medians, cores of the
    rows that have some; slow_ms the longest of the same rows, or what imported
    (project, task, slow_ms) says of a remote one. With current (project, task,
    def) rows of another definition are passed over; those without one count,
    and so do those of a task that current doesn't name.
    """
    own, remote, any_ = F.col("source") == branch, F.col("source") == "remote", F.startswith("source", F.lit("branch:"))
    if current is not None:
        durations = durations.join(current.select("project", "task", F.col("def").alias("now")), ["project", "task"], "left").where("def IS NULL OR now IS NULL OR def = now")
    tiers = F.filter(F.array(F.when(own, 0), F.when(remote, 1), F.when(any_, 2)), lambda x: x.isNotNull())
    rows = durations.select("id", "project", "task", "duration_ms", "cores", F.explode(tiers).alias("tier"))
    n = F.row_number().over(Window.partitionBy("project", "task", "tier").orderBy(F.desc("id")))
    # few rows of a key leave each partition before the shuffle
    rows = rows.withColumn("n", n).where(F.col("n") <= runs).where("tier <> 1 OR n = 1")
    each = rows.groupBy("project", "task", "tier").agg(M.nearest_rank(F.col("duration_ms"), 0.5).alias("duration_ms"), M.nearest_rank(F.col("cores"), 0.5).alias("cores"), F.max("duration_ms").alias("slow_ms"))
    first = each.groupBy("project", "task").agg(F.min_by(F.struct("tier", "duration_ms", "cores", "slow_ms"), "tier").alias("m")).select("project", "task", "m.*")
    if imported is not None:
        known = imported.select("project", "task", F.col("slow_ms").alias("known"))
        first = first.join(known, ["project", "task"], "left").withColumn("slow_ms", F.when(F.col("tier") == 1, F.coalesce("known", "slow_ms")).otherwise(F.col("slow_ms"))).drop("known")
    return first.withColumn("tier", F.get(F.array(*map(F.lit, ("own", "remote", "any"))), F.col("tier")))
