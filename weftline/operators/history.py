"""Scans, lookups and retention over run rows and invocation headers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _clamped(limit: int, most: int) -> int:
    return max(1, min(limit, most))


def list_runs(runs: DataFrame, limit: int = 100, project: str | None = None, task: str | None = None, run_id: str | None = None) -> DataFrame:
    """Newest first."""
    for column, value in (("project", project), ("task", task), ("run_id", run_id)):
        if value is not None:
            runs = runs.where(F.col(column) == value)
    return runs.orderBy(F.desc("id")).limit(_clamped(limit, 100_000))


def list_invocations(invocations: DataFrame, limit: int = 50, failed_only: bool = False) -> DataFrame:
    if failed_only:
        invocations = invocations.where(~F.col("exit_ok"))
    return invocations.orderBy(F.desc("run_id")).limit(_clamped(limit, 500))


def run_rows(runs: DataFrame, run_id: str) -> DataFrame:
    """Rows of one run with its start and end beside each; the window holds that run only."""
    own = runs.where(F.col("run_id") == run_id)
    ends = own.agg(F.min("started_at").alias("run_start"), F.max("ended_at").alias("run_end"))
    return own.crossJoin(F.broadcast(ends))


def window_floor(runs: DataFrame, invocations: DataFrame, newest: int = 50) -> DataFrame:
    """One row: the first row id of the newest invocations.

    0 if there are fewer than `newest`; one past the largest id if none of them has rows.
    """
    last = invocations.orderBy(F.desc("run_id")).limit(newest)
    n = last.agg(F.count("*").alias("n"))
    first = runs.join(F.broadcast(last.select("run_id")), "run_id", "left_semi").agg(F.min("id").alias("first"))
    top = runs.agg(F.max("id").alias("top"))
    floor = F.when(F.col("n") < newest, F.lit(0)).otherwise(F.coalesce("first", F.col("top") + 1, F.lit(0)))
    return n.crossJoin(first).crossJoin(top).select(floor.cast("long").alias("floor"))


def latest_run(runs: DataFrame) -> DataFrame:
    return runs.groupBy("project", "task").agg(F.max_by("run_id", "id").alias("run_id"))


def resolve_prefix(invocations: DataFrame, prefix: str) -> DataFrame:
    """One row: exact, unique, ambiguous or none, and up to five candidates in order. A range, so Parquet can prune."""
    hits = invocations.where((F.col("run_id") >= prefix) & (F.col("run_id") < prefix + "~")).select("run_id")
    few = hits.orderBy("run_id").limit(5).agg(F.sort_array(F.collect_list("run_id")).alias("shown"))
    n = hits.agg(F.count("*").alias("matches"), F.coalesce(F.max(F.col("run_id") == prefix), F.lit(False)).alias("is_exact"))
    verdict = F.when(F.col("is_exact"), "exact").when(F.col("matches") == 1, "unique").when(F.col("matches") > 1, "ambiguous").otherwise("none")
    return n.crossJoin(few).select(verdict.alias("verdict"), "matches", F.array_join("shown", ",").alias("shown"))


def shortest_prefix(ids: DataFrame, least: int) -> DataFrame:
    """The fewest leading characters, `least` at least, that tell an id from its neighbours in order.

    Neighbours meet within the shard of ids that share the first `least`
    characters, so no task sorts them all. Ids of different shards differ there.
    """
    w = Window.partitionBy("shard").orderBy("run_id")
    near = ids.withColumn("shard", F.substring("run_id", 1, least)).select("run_id", F.lag("run_id").over(w).alias("a"), F.lead("run_id").over(w).alias("b"))

    def shared(other: str):
        same = F.expr(f"aggregate(sequence(1, length(run_id)), 0, (n, i) -> IF(n = i - 1 AND substring(run_id, i, 1) = substring({other}, i, 1), i, n))")
        return F.coalesce(F.when(F.col(other).isNotNull(), same), F.lit(0))

    n = F.greatest(shared("a") + 1, shared("b") + 1, F.lit(least))
    return near.select("run_id", F.expr("run_id").substr(F.lit(1), n).alias("prefix"))


def keep_newest_runs(notes: DataFrame, runs: int = 50) -> DataFrame:
    """Rows of the newest runs. The run ids are ranked once each, not the rows."""
    ids = notes.select("run_id").distinct().orderBy(F.desc("run_id")).limit(runs)
    return notes.join(F.broadcast(ids), "run_id", "left_semi")


def insert_or_ignore(present: DataFrame, new: DataFrame, *keys: str) -> DataFrame:
    """present and those rows of new whose keys it lacks; of equal new keys one row."""
    return present.unionByName(new.dropDuplicates(list(keys)).join(present.select(*keys), list(keys), "left_anti"))


def retained(rows: DataFrame, column: str, cutoff: int) -> DataFrame:
    return rows.where(F.col(column) >= cutoff)


def retained_relations(relations: dict[str, DataFrame], at: dict[str, str], cutoff: int) -> dict[str, DataFrame]:
    """Relations by name, each without its rows before one cutoff of its own column."""
    return {name: retained(rows, at[name], cutoff) for name, rows in relations.items()}


def by_precedence(rows: DataFrame, exact: DataFrame, ranges: DataFrame, names: DataFrame) -> DataFrame:
    """(entry, v) of rows (entry, project, version): exact (entry, v), else the least of ranges (project, lo, hi, v) that
    hold the version, else names (project, v).

    Versions are arrays of numbers, so that 10 comes after 2; lo belongs to a range, hi doesn't.
    """
    inside = (F.col("version") >= F.col("lo")) & (F.col("version") < F.col("hi"))
    hit = rows.join(ranges, "project").where(inside).groupBy("entry").agg(F.min("v").alias("_range"))
    j = rows.join(exact.withColumnRenamed("v", "_exact"), "entry", "left").join(hit, "entry", "left").join(names.withColumnRenamed("v", "_name"), "project", "left")
    return j.select("entry", F.coalesce("_exact", "_range", "_name").alias("v"))


def without_orphans(children: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    return children.join(parents.select(key), key, "left_semi")


def swept(rows: DataFrame, moment: DataFrame, days: int = 30, at: str = "updated_at") -> DataFrame:
    """rows less those older than `days` at moment's one row (now, swept); all of them within a day of the last sweep, or without a moment."""
    m = moment.select("now", F.coalesce("swept", F.lit(0)).alias("_swept"))
    day = 86_400_000
    due = F.coalesce(F.col("now") - F.col("_swept") >= day, F.lit(False))
    return rows.join(F.broadcast(m.limit(1)), F.lit(True), "left").where(~due | F.coalesce(F.col(at) >= F.col("now") - days * day, F.lit(True))).drop("now", "_swept")


def worker_measures(run: DataFrame, known: DataFrame, size: str) -> DataFrame:
    """Per machine size the warm-up to record, at most twice the known one, and the pace in thousandths.

    run is (size, warm, pace), known (size, known); a size without a known warm-up keeps its own.
    """
    j = run.join(known, size, "left")
    return j.select(size, F.least("warm", F.col("known") * 2).alias("warm_ms"), F.floor(F.col("pace") * 1000 + 0.5).alias("pace"))
