"""As-of lookups, interval joins, sweep lines and running totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import predicates as P

#: Ids of a cell: a window over one key sorts so many rows at most.
CELL = 1 << 20


def neighbour(rows: DataFrame, value: Column, *keys: str, later: bool = False, cell: int = CELL) -> DataFrame:
    """rows with _near: the value of the nearest earlier (or later) row of its keys that has one, by id."""
    return neighbours(rows, {"_near": value}, *keys, later=later, cell=cell)


def neighbours(rows: DataFrame, values: dict[str, Column], *keys: str, later: bool = False, cell: int = CELL) -> DataFrame:
    """rows with each of values, by its name: that of the nearest earlier (or later) row of its keys that has one, by id.

    A key may hold any share of the rows, so its ids are cut into cells. A
    window finds the value inside a cell; where there is none it comes from
    the nearest cell before, of which there is one row each. Values are made
    of the rows' own columns after the shuffle, which they don't widen.
    """
    rows = rows.withColumn("_cell", F.floor(F.col("id") / cell))
    order, pick = (F.desc, F.min_by) if later else (F.asc, F.max_by)
    before = (Window.unboundedPreceding, -1)
    # the nearest comes last before a row, so the frame only grows: one pass over a partition
    inside = Window.partitionBy(*keys, "_cell").orderBy(order("id")).rowsBetween(*before)
    outside = Window.partitionBy(*keys).orderBy(order("_cell")).rowsBetween(*before)
    each = {n: f"_value{i}" for i, n in enumerate(values)}
    valued = lambda df: df.withColumns({each[n]: v for n, v in values.items()})
    some = lambda v: F.when(F.col(v).isNotNull(), F.col("id"))
    cells = valued(rows).groupBy(*keys, "_cell").agg(*[pick(v, some(v)).alias(v) for v in each.values()])
    cells = cells.select(*keys, "_cell", *[F.last(v, ignorenulls=True).over(outside).alias(f"{v}_outside") for v in each.values()])
    out = valued(rows.repartition(*keys, "_cell")).withColumns({f"{v}_inside": F.last(v, ignorenulls=True).over(inside) for v in each.values()}).join(cells, [*keys, "_cell"])
    out = out.withColumns({n: F.coalesce(f"{v}_inside", f"{v}_outside") for n, v in each.items()})
    return out.drop("_cell", *[f"{v}{end}" for v in each.values() for end in ("", "_inside", "_outside")])


def previous_keyed(runs: DataFrame) -> DataFrame:
    """Beside each keyed row: key and id of the task's keyed row before it."""
    own = runs.where(P.keyed()).select("id", "project", "task", "hash")
    near = neighbour(own, F.struct(F.col("id").alias("prev_id"), F.col("hash").alias("prev_hash")), "project", "task")
    return near.select("id", "project", "task", "hash", "_near.prev_id", "_near.prev_hash")


def fixed_in(runs: DataFrame) -> DataFrame:
    """Beside each failed row: the first later run in which its task passed."""
    rows = runs.select("id", "project", "task", "run_id", "status")
    near = neighbour(rows, F.when(P.passed(), F.col("run_id")), "project", "task", later=True)
    return near.where("status = 'failed'").select("id", "project", "task", "run_id", "status", F.col("_near").alias("fixed_in"))


def running_at(points: DataFrame, spans: DataFrame, slack: int = 5, first: int = 3, bucket: int = 60_000) -> DataFrame:
    """(point_id, place, project, task, start): the tasks that ran at each point (point_id, at), the `first` earliest.

    Both sides are dealt to time buckets: a span to all that it touches, a
    point to its own. A bucket is one stream in order of time with the open
    spans by start, so a point reads the first few of them and never meets all
    that are near. A task with several spans there counts once, by the earliest.
    """
    import bisect
    import heapq

    none = lambda kind: F.lit(None).cast(kind)
    s = spans.select(
        F.explode(F.sequence(F.expr(f"(start - {slack}) div {bucket}"), F.expr(f"(stop + {slack}) div {bucket}"))).alias("cell"), (F.col("start") - slack).alias("moment"), F.lit(0).alias("kind"),
        none("bigint").alias("point_id"), "project", "task", F.col("start").cast("bigint").alias("start"), (F.col("stop") + slack).cast("bigint").alias("until"),
    )
    id_type = points.schema["point_id"].dataType.simpleString()
    p = points.select(F.expr(f"at div {bucket}").alias("cell"), F.col("at").alias("moment"), F.lit(1).alias("kind"), F.col("point_id").cast("bigint").alias("point_id"), none("string").alias("project"), none("string").alias("task"), none("bigint").alias("start"), none("bigint").alias("until"))

    def run(parts):
        import pyarrow as pa

        at, open_, ends = None, [], []
        for part in parts:
            out = []
            for cell, moment, kind, point, project, task, start, until in zip(*[part.column(k).to_pylist() for k in range(8)], strict=True):
                if cell != at:
                    at, open_, ends = cell, [], []
                if not kind:
                    own = (start, project, task, until)
                    bisect.insort(open_, own)
                    heapq.heappush(ends, (until, own))
                    continue
                while ends and ends[0][0] < moment:
                    own = heapq.heappop(ends)[1]
                    del open_[bisect.bisect_left(open_, own)]
                met: set = set()
                for start_, project_, task_, _ in open_:
                    if (project_, task_) not in met:
                        met.add((project_, task_))
                        out.append((point, len(met), project_, task_, start_))
                        if len(met) == first:
                            break
            kinds = [pa.int64(), pa.int32(), pa.string(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)], ["point_id", "place", "project", "task", "start"])

    dealt = s.unionByName(p).repartition("cell").sortWithinPartitions("cell", "moment", "kind")
    return dealt.mapInArrow(run, "point_id bigint, place int, project string, task string, start bigint").withColumn("point_id", F.col("point_id").cast(id_type))


def _events(spans: DataFrame, *keys: str) -> DataFrame:
    up = spans.select(*keys, F.col("start").alias("at"), F.lit(1).alias("delta"), F.col("cores").alias("d_cores"), F.col("memory").alias("d_memory"))
    down = spans.select(*keys, F.col("stop").alias("at"), F.lit(-1).alias("delta"), (-F.col("cores")).alias("d_cores"), (-F.col("memory")).alias("d_memory"))
    # equal moments together first: a third of all rows at one moment are then one row, and ends count before starts
    return up.unionByName(down).groupBy(*keys, "at", "delta").agg(F.sum("delta").alias("n"), F.sum("d_cores").alias("d_cores"), F.sum("d_memory").alias("d_memory"))


def concurrency(spans: DataFrame, *keys: str, cell: int = 3_600_000) -> DataFrame:
    """Per key: peak number, cores and memory of open spans, and the time that any was open.

    Spans that end at a moment end before those that start there. Moments are
    summed up first, running sums go over cells of time, and what is integrated
    needs no order at all: the sum of value times time is that of each change
    times its moment.
    """
    e = _events(spans, *keys).groupBy(*keys, "at").agg(F.sum("n").alias("n"), F.sum("d_cores").alias("d_cores"), F.sum("d_memory").alias("d_memory"))
    e = running_in_cells(e, "at", list(keys), {"was": F.col("n"), "was_cores": F.col("d_cores"), "was_memory": F.col("d_memory")}, {}, cell)
    open_ = F.col("was") + F.col("n")
    busy = F.when((F.col("was") > 0) & (open_ <= 0), F.col("at")).when((F.col("was") <= 0) & (open_ > 0), -F.col("at"))
    return e.groupBy(*keys).agg(
        F.max(open_).alias("peak_open"), F.max(F.col("was_cores") + F.col("d_cores")).alias("peak_cores"), F.max(F.col("was_memory") + F.col("d_memory")).alias("peak_memory"),
        F.coalesce(F.sum(busy), F.lit(0)).alias("busy_ms"), F.coalesce(-F.sum(F.col("d_cores") * F.col("at")), F.lit(0)).alias("core_ms"),
    )


def utilization(spans: DataFrame, machine_cores: int, *keys: str) -> DataFrame:
    """Core-milliseconds over what the machine offered between its first and last moment, at most 1."""
    ends = spans.groupBy(*keys).agg((F.max("stop") - F.min("start")).alias("online_ms"))
    j = concurrency(spans, *keys).join(ends, list(keys))
    ratio = F.try_divide(F.col("core_ms").cast("double"), (F.col("online_ms") * machine_cores).cast("double"))
    mean = F.try_divide(F.col("core_ms").cast("double"), F.col("online_ms").cast("double"))
    return j.select(*keys, "online_ms", F.least(F.lit(1.0), ratio).alias("utilization"), mean.alias("mean_cores"))


def evicted(entries: DataFrame, most_bytes: int, buckets: int = 1024) -> DataFrame:
    """Entries to drop, oldest access first, until what stays has at most most_bytes.

    The running total is taken in two levels: sums of hash-free ranges of
    access time, then inside the ranges. No task orders all entries.
    """
    ends = entries.agg(F.min("accessed_at").alias("lo"), F.max("accessed_at").alias("hi"), F.sum("size_bytes").alias("total"))
    at = entries.crossJoin(F.broadcast(ends))
    cell = F.least(F.lit(buckets - 1), F.floor((F.col("accessed_at") - F.col("lo")) / (F.col("hi") - F.col("lo") + 1) * buckets))
    at = at.withColumn("cell", cell)
    sums = at.groupBy("cell").agg(F.sum("size_bytes").alias("s"))
    # one row for each of at most `buckets` ranges
    before = sums.select("cell", F.coalesce(F.sum("s").over(Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    own = F.coalesce(F.sum("size_bytes").over(Window.partitionBy("cell").orderBy("accessed_at", "entry").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    j = at.join(F.broadcast(before), "cell").withColumn("earlier", F.col("before") + own)
    return j.where(F.col("total") - F.col("earlier") > most_bytes).select("entry", "accessed_at", "size_bytes")


def newest_per_task(durations: DataFrame, k: int = 5, *keys: str) -> DataFrame:
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("id")))
    return durations.withColumn("place", n).where(F.col("place") <= k)


def step_integral(steps: DataFrame, *keys: str, cell: int = CELL) -> DataFrame:
    """Value times time of a step function (keys, at, value) up to its last moment."""
    near = neighbour(steps.select(*keys, F.col("at").alias("id"), "value"), F.col("id"), *keys, later=True, cell=cell)
    return near.groupBy(*keys).agg(F.coalesce(F.sum(F.col("value") * (F.col("_near") - F.col("id"))), F.lit(0)).alias("integral"))


def settled_changes(rows: DataFrame, cell: int = CELL) -> DataFrame:
    """Rows whose state differs from the state last seen of their key; a first sighting passes."""
    near = neighbour(rows, F.struct("state"), "key", cell=cell)
    return near.where(F.col("_near").isNull() | ~F.col("state").eqNullSafe(F.col("_near.state"))).drop("_near")


def running_in_cells(rows: DataFrame, at: str, keys: list[str], sums: dict[str, Column], maxima: dict[str, Column], cell: int, *ties: str) -> DataFrame:
    """rows with running sums and maxima over all rows of their keys that come earlier by `at`, none of the same moment.

    With ties, columns that order equal moments, also those before it there.

    A key may hold any share of the rows. Its moments are cut into cells of
    `cell` units; what a row sees is its part of its own cell and what all
    earlier cells add up to, of which there is one row each.
    """
    rows = rows.withColumn("_cell", F.floor(F.col(at) / cell)).withColumns({f"_v_{k}": v for k, v in (sums | maxima).items()})
    before, here = Window.partitionBy(*keys).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(*keys, "_cell").orderBy(at, *ties)
    inside = here.rowsBetween(Window.unboundedPreceding, -1) if ties else here.rangeBetween(Window.unboundedPreceding, -1)
    how = {k: F.sum for k in sums} | {k: F.max for k in maxima}
    cells = rows.groupBy(*keys, "_cell").agg(*[f(f"_v_{k}").alias(f"_c_{k}") for k, f in how.items()])
    cells = cells.select(*keys, "_cell", *[f(f"_c_{k}").over(before).alias(f"_b_{k}") for k, f in how.items()])
    own = rows.select("*", *[f(f"_v_{k}").over(inside).alias(f"_i_{k}") for k, f in how.items()]).join(cells, [*keys, "_cell"])
    total = {k: F.coalesce(f"_b_{k}", F.lit(0)) + F.coalesce(f"_i_{k}", F.lit(0)) for k in sums} | {k: F.greatest(f"_b_{k}", f"_i_{k}") for k in maxima}
    return own.withColumns(total).drop("_cell", *[f"_{p}_{k}" for p in "vbi" for k in how])


def timeline_rows(spans: DataFrame, *keys: str, cell: int = 3_600_000) -> DataFrame:
    """spans (keys, id, start, stop) with row: the first row of their key that is free when they start.

    A row is free from the stop of its last span on. Spans go by start, equals
    by id. When none runs, all rows are free, so a key is split at its idle
    moments: a stretch between two is one stream through a heap of free rows
    and one of running spans, and no task need hold a key.
    """
    import heapq

    latest = running_in_cells(spans, "start", list(keys), {}, {"_last": F.col("stop")}, cell)
    opens = latest.groupBy(*keys, "start").agg(F.min(F.coalesce(F.col("_last") <= F.col("start"), F.lit(True)).cast("int")).alias("_n"))
    # the stretch of a moment is the number of moments before it, itself included, that found all rows free
    stretch = running_in_cells(opens, "start", list(keys), {"_before": F.col("_n")}, {}, cell)
    s = spans.join(stretch.select(*keys, "start", (F.col("_before") + F.col("_n")).alias("_stretch")), [*keys, "start"])
    names, place = [*spans.columns], {c: k for k, c in enumerate([*keys, "_stretch", "id", "start", "stop"])}

    def run(parts):
        import pyarrow as pa

        at, free, busy, made = None, [], [], 0
        for part in parts:
            cols = [part.column(c).to_pylist() for c in place]
            rows = []
            for r in zip(*cols, strict=True):
                key, start, stop = r[: len(keys) + 1], r[place["start"]], r[place["stop"]]
                if key != at:
                    at, free, busy, made = key, [], [], 0
                while busy and busy[0][0] <= start:
                    heapq.heappush(free, heapq.heappop(busy)[1])
                if free:
                    row = heapq.heappop(free)
                else:
                    made += 1
                    row = made
                heapq.heappush(busy, (stop, row))
                rows.append(row)
            yield pa.RecordBatch.from_arrays([*[part.column(c) for c in names], pa.array(rows, pa.int64())], [*names, "row"])

    schema = spans.schema.add("row", "long")
    dealt = s.repartition(*keys, "_stretch").sortWithinPartitions(*keys, "_stretch", "start", "id")
    return dealt.mapInArrow(run, schema)


def trace_events(spans: DataFrame, marks: DataFrame, key: str, cell: int = 3_600_000) -> DataFrame:
    """(key, ph, ts, event): slices, counters and marks of a timeline as one JSON text each, times in microseconds.

    spans: (key, id, name, start, stop, cores, memory); marks: (key, name, at).
    A slice (X) lies in the first row that is free when it starts; row 0 is
    left to what belongs to the whole key. A counter (C) gives the cores and
    memory in use after all that starts or stops at a moment; spans without
    length change none. A mark (i) is a moment. Spans that stop before they
    start, or lack either, give nothing.
    """
    spans = spans.where("stop >= start")
    us = lambda c: (F.col(c) * 1000).cast("long")
    x = timeline_rows(spans, key, cell=cell).select(key, F.lit("X").alias("ph"), us("start").alias("ts"), F.struct(F.lit("X").alias("ph"), "name", F.col(key).alias("pid"), F.col("row").alias("tid"), us("start").alias("ts"), (us("stop") - us("start")).alias("dur")).alias("e"))
    moments = _events(spans.where("stop > start"), key).groupBy(key, "at").agg(F.sum("d_cores").alias("d_cores"), F.sum("d_memory").alias("d_memory"))
    moments = running_in_cells(moments, "at", [key], {"cores": F.col("d_cores"), "memory": F.col("d_memory")}, {}, cell)
    used = F.struct((F.col("cores") + F.col("d_cores")).alias("cores"), (F.col("memory") + F.col("d_memory")).alias("memory"))
    c = moments.select(key, F.lit("C").alias("ph"), us("at").alias("ts"), F.struct(F.lit("C").alias("ph"), F.lit("in use").alias("name"), F.col(key).alias("pid"), F.lit(0).alias("tid"), us("at").alias("ts"), used.alias("args")).alias("e"))
    i = marks.select(key, F.lit("i").alias("ph"), us("at").alias("ts"), F.struct(F.lit("i").alias("ph"), F.lit("p").alias("s"), "name", F.col(key).alias("pid"), F.lit(0).alias("tid"), us("at").alias("ts")).alias("e"))
    out = [part.select(key, "ph", "ts", F.to_json("e").alias("event")) for part in (x, c, i)]
    return out[0].unionByName(out[1]).unionByName(out[2])
