"""Task statistics, flakiness and summaries of runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import measures as M
from ..functions import predicates as P
from .graph import affected


def count_if(c: Column) -> Column:
    return F.count(F.when(c, 1))


def with_running_counts(counted: DataFrame, value: str, n: str, *keys: str) -> DataFrame:
    """counted (one row for each of keys and value, n times) with _upto, how many of a key are at most its value, and _of, how many it has.

    Rows with a null value count as none. A key's distinct values are sorted, which can spill; its rows never meet in a list.
    """
    by = Window.partitionBy(*keys)
    some = F.when(F.col(value).isNotNull(), F.col(n)).otherwise(0)
    return counted.withColumns({"_upto": F.sum(some).over(by.orderBy(value).rowsBetween(Window.unboundedPreceding, 0)), "_of": F.sum(some).over(by)})


def percentiles(rows: DataFrame, value: str, ranks: dict[str, float], *keys: str) -> DataFrame:
    """Per key: sorted[floor(q * n)] of its values for each name and q of ranks."""
    counted = with_running_counts(rows.groupBy(*keys, value).agg(F.count("*").alias("_n")), value, "_n", *keys)
    return counted.groupBy(*keys).agg(*[M.counted_rank(F.col(value), q).alias(name) for name, q in ranks.items()])


def task_stats(runs: DataFrame, *keys: str) -> DataFrame:
    """Counts, rates and duration percentiles of executed rows. A hit counts in rates, not in durations."""
    own = F.when(~F.coalesce("cache_hit", F.lit(False)) & (F.col("status") == "success"), F.col("duration_ms"))
    by_value = runs.where(P.executed()).withColumn("_own", own).groupBy(*keys, "_own").agg(
        F.count("*").alias("total"), count_if(P.passed()).alias("successes"), count_if(F.coalesce("cache_hit", F.lit(False))).alias("hits"),
        count_if(F.col("status") == "failed").alias("failures"), count_if((F.col("status") == "success") & (F.col("attempts") > 1)).alias("retried"),
    )
    sums = [F.sum(c).alias(c) for c in ("total", "successes", "hits", "failures", "retried")]
    ranks = [M.counted_rank(F.col("_own"), 0.5).alias("p50"), M.counted_rank(F.col("_own"), 0.99).alias("p99")]
    g = with_running_counts(by_value, "_own", "total", *keys).groupBy(*keys).agg(*sums, *ranks)
    return g.withColumns({"success_rate": M.share(F.col("successes"), F.col("total")), "hit_rate": M.share(F.col("hits"), F.col("total"))})


def key_outcomes(runs: DataFrame) -> DataFrame:
    """Per task and key: failures, passes, retried failures (the failed attempts of passes), and relapses, which are failures after the first pass."""
    rows = runs.where(P.keyed() & P.not_uncached() & F.col("blocked_by").isNull())
    passed = P.passed() | F.coalesce("cache_hit", F.lit(False))
    # the first pass comes from a second, small table: a window would sort all rows of a key in one task
    first = rows.where(passed).groupBy("project", "task", "hash").agg(F.min("id").alias("first_pass"))
    failed, again = F.col("status") == "failed", (F.col("status") == "success") & (F.col("attempts") > 1)
    counts = rows.groupBy("project", "task", "hash").agg(
        count_if(failed).alias("failures"), count_if(passed).alias("passes"), F.coalesce(F.sum(F.when(again, F.col("attempts") - 1)), F.lit(0)).alias("retried")
    )
    late = rows.where(failed).join(first, ["project", "task", "hash"]).where("id > first_pass").groupBy("project", "task", "hash").agg(F.count("*").alias("relapses"))
    return counts.join(late, ["project", "task", "hash"], "left").withColumn("relapses", F.coalesce("relapses", F.lit(0)))


def mixed_keys(runs: DataFrame) -> DataFrame:
    return key_outcomes(runs).where("relapses > 0").groupBy("project", "task").agg(F.count("*").alias("mixed"))


def flaky_tasks(runs: DataFrame) -> DataFrame:
    """Tasks with keys that relapsed or passed on a retry, most failures first; counts over those keys, failed attempts included."""
    keys = key_outcomes(runs).where("relapses > 0 OR retried > 0")
    g = keys.groupBy("project", "task").agg(
        F.count("*").alias("keys"), F.sum(F.col("failures") + F.col("retried")).alias("failures"), F.sum("passes").alias("passes"), F.sum("retried").alias("retried"), count_if(F.col("relapses") > 0).alias("mixed")
    )
    return g.orderBy(F.desc("failures"), F.desc("passes"), "project", "task")


def failure_modes(runs: DataFrame) -> DataFrame:
    again = (F.col("status") == "success") & (F.col("attempts") > 1)
    stats = runs.where(P.executed()).groupBy("project", "task").agg(F.count("*").alias("total"), count_if(F.col("status") == "failed").alias("failures"), count_if(again).alias("retried"))
    j = stats.join(mixed_keys(runs), ["project", "task"], "left").withColumn("mixed", F.coalesce("mixed", F.lit(0)))
    return j.withColumn("mode", M.failure_mode(F.col("retried"), F.col("failures"), F.col("mixed"), F.col("total")))


def flaky_candidates(history: DataFrame, candidates: DataFrame) -> DataFrame:
    """Of the executed keyed rows of a run (candidates), those that show their task to be flaky, beside the history before it.

    A failure does on a key that has passed, a pass on a key that has failed
    after passing, and a pass that took a retry by itself. The counts take
    the row in.
    """
    known = key_outcomes(history.join(candidates.select("project", "task", "hash").distinct(), ["project", "task", "hash"], "left_semi"))
    j = candidates.select("id", "project", "task", "hash", "status", "attempts").join(known.select("project", "task", "hash", "failures", "passes", "relapses"), ["project", "task", "hash"], "left").fillna(0, ["failures", "passes", "relapses"])
    failed, again = F.col("status") == "failed", (F.col("status") == "success") & (F.coalesce("attempts", F.lit(1)) > 1)
    relapsed = F.when(failed, F.col("passes") > 0).otherwise(F.col("relapses") > 0)
    return j.where(relapsed | again).select("id", "project", "task", "hash", "status", (F.col("passes") + F.when(failed, 0).otherwise(1)).alias("passes"), (F.col("failures") + F.when(failed, 1).otherwise(0)).alias("failures"))


def known_flaky(runs: DataFrame, asked: DataFrame) -> DataFrame:
    """asked (project, task, hash) with flaky: the key has passed, or a key of the task relapsed or passed on a retry."""
    outcomes = key_outcomes(runs)
    passed = outcomes.where("passes > 0").select("project", "task", "hash", F.lit(True).alias("_passed"))
    task = outcomes.where("relapses > 0 OR retried > 0").select("project", "task", F.lit(True).alias("_task")).distinct()
    j = asked.distinct().join(passed, ["project", "task", "hash"], "left").join(task, ["project", "task"], "left")
    return j.select("project", "task", "hash", (F.col("_passed").isNotNull() | F.col("_task").isNotNull()).alias("flaky"))


def produced(runs: DataFrame, entries: DataFrame) -> DataFrame:
    """Per task that was hit: peak memory, cores and duration of what its distinct hit keys were produced by."""
    hits = runs.where("cache_hit").select("project", "task", "hash").distinct()
    j = hits.join(entries.select("project", "task", "hash", F.col("size_bytes").alias("ms"), "cpu_ms", F.col("peak_rss").alias("rss")), ["project", "task", "hash"])
    some = F.when(F.col("ms") > 0, F.col("ms"))
    return j.groupBy("project", "task").agg(F.max("rss").alias("hit_rss"), F.max(F.try_divide(F.col("cpu_ms").cast("double"), some.cast("double"))).alias("hit_cpu"), F.max(some).alias("hit_ms"))


def own_rows(runs: DataFrame) -> DataFrame:
    return runs.where(~F.coalesce("cache_hit", F.lit(False)))


def mean_need(runs: DataFrame, entries: DataFrame) -> DataFrame:
    """Mean need of a task's own successes; only where none was measured, the largest ratio of what it hit."""
    own = own_rows(runs).where("status = 'success' AND cpu_ms IS NOT NULL AND duration_ms > 0").groupBy("project", "task").agg(F.avg(M.need()).alias("own"))
    j = runs.where(P.executed()).select("project", "task").distinct().join(own, ["project", "task"], "left").join(produced(runs, entries), ["project", "task"], "left")
    return j.select("project", "task", F.coalesce("own", "hit_cpu").alias("need"))


def saturated(runs: DataFrame, least: float = 0.9) -> DataFrame:
    """Per task the largest machine whose cores its runs filled on the mean, and the largest memory that one filled.

    Failures count: a task killed for memory filled its machine too.
    """
    rows = own_rows(runs).where("cores IS NOT NULL AND duration_ms > 0 AND status IN ('success', 'failed')")
    full = F.when(F.col("peak_rss") >= F.col("placement_memory") * least, F.col("placement_memory"))
    by_size = rows.groupBy("project", "task", "cores").agg(F.avg(M.need() / F.col("cores")).alias("fill"), F.max(full).alias("memory"))
    g = by_size.groupBy("project", "task").agg(F.max(F.when(F.col("fill") >= least, F.col("cores"))).alias("cores"), F.max("memory").alias("memory"))
    return g.where("cores IS NOT NULL OR memory IS NOT NULL")


def cache_stats(entries: DataFrame, runs: DataFrame, now: int, project: str | None = None) -> DataFrame:
    """One row: entries and bytes, and of the last 24 hours runs, hits and restored time."""
    if project is not None:
        entries, runs = entries.where(F.col("project") == project), runs.where(F.col("project") == project)
    a = entries.agg(F.count("*").alias("entries"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("bytes"))
    day = runs.where((F.col("started_at") > now - 86_400_000) & (F.col("started_at") <= now))
    b = day.agg(count_if(P.executed()).alias("runs"), count_if(P.hit()).alias("hits"), F.coalesce(F.sum(F.when(P.hit(), F.col("duration_ms"))), F.lit(0)).alias("restored_ms"))
    return a.crossJoin(b)


def single_timings(durations: DataFrame, since: int) -> DataFrame:
    """Tasks with exactly one timing, which is at or after row `since`."""
    g = durations.groupBy("project", "task").agg(F.count("*").alias("n"), F.min("id").alias("id"))
    return g.where((F.col("n") == 1) & (F.col("id") >= since)).drop("n")


def _hit_counts() -> list[Column]:
    """Hits by what became of their outputs: an output not known to be restored was up to date."""
    restored = F.coalesce("restored", F.lit(False))
    local, remote = F.col("status") == "cache-hit", F.col("status") == "cache-hit-remote"
    return [count_if(P.hit() & ~restored).alias("up_to_date"), count_if(local & restored).alias("restored_local"), count_if(remote & restored).alias("restored_remote")]


def run_headers(runs: DataFrame) -> DataFrame:
    """Counts of each run's rows; rows that a stop cut off are none."""
    return runs.where("status <> 'aborted'").groupBy("run_id").agg(
        F.count("*").alias("tasks"), count_if(F.col("status") == "failed").alias("failed"), count_if(P.hit()).alias("hits"), count_if(F.col("status") == "cache-hit").alias("hits_local"), count_if(F.col("status") == "cache-hit-remote").alias("hits_remote"), *_hit_counts()
    )


def tally(outcomes: DataFrame) -> DataFrame:
    """Outcomes of each run by bucket. An aborted one is counted as such and not in the total."""
    n = lambda status: count_if(F.col("status") == status)
    return outcomes.groupBy("run_id").agg(
        count_if(F.col("status") != "aborted").alias("total"), count_if(P.passed()).alias("successful"), n("failed").alias("failed"), n("skipped").alias("skipped"), n("cache-hit").alias("cached_local"), n("cache-hit-remote").alias("cached_remote"), n("aborted").alias("aborted"), *_hit_counts()
    )


def cache_bucket() -> Column:
    """What the cache was to a finished row: nothing for skips, and for failures without a key."""
    status, ran = F.col("status"), F.when(F.col("cached").eqNullSafe(F.lit(False)), "noCache")
    success = F.coalesce(ran, F.when(F.col("saved"), "saved"), F.when(~F.col("saved"), "notSaved"), F.lit("miss"))
    failed = F.when(F.col("hash") != "", F.coalesce(ran, F.lit("miss")))
    kept = F.when(F.col("restored").eqNullSafe(F.lit(False)), "upToDate")
    return (
        F.when(status == "success", success).when(status == "failed", failed)
        .when(status == "cache-hit", F.coalesce(kept, F.lit("restoredLocal"))).when(status == "cache-hit-remote", F.coalesce(kept, F.lit("restoredRemote")))
    )


def cache_buckets(runs: DataFrame) -> DataFrame:
    return runs.withColumn("bucket", cache_bucket()).where("bucket IS NOT NULL").groupBy("bucket").agg(F.count("*").alias("n"))


def duration_spread(runs: DataFrame, *keys: str) -> DataFrame:
    d = F.col("duration_ms")
    return runs.where(P.executed() & ~P.hit()).groupBy(*keys).agg(F.max(d).alias("longest"), F.min(d).alias("shortest"), F.sum(d).alias("total_ms"), F.count(d).alias("n"))


def time_saved(runs: DataFrame, entries: DataFrame) -> DataFrame:
    """Per project: the stored durations of what was hit."""
    hits = runs.where(P.hit() & P.keyed()).select("project", "task", "hash")
    j = hits.join(entries.select("project", "task", "hash", "size_bytes"), ["project", "task", "hash"], "left")
    return j.groupBy("project").agg(F.sum(F.coalesce("size_bytes", F.lit(0))).alias("saved_ms"))


def blocked_by(runs: DataFrame) -> DataFrame:
    """Per blocker of a run: the tasks that it kept from running, in order. A run's tasks are bounded."""
    rows = runs.where("blocked_by IS NOT NULL").select("run_id", "blocked_by", F.concat_ws("#", "project", "task").alias("t"))
    return rows.groupBy("run_id", "blocked_by").agg(F.array_join(F.sort_array(F.collect_set("t")), ",").alias("tasks"))


def reservations(runs: DataFrame) -> DataFrame:
    return runs.where(P.executed()).groupBy("project", "task").agg(M.reserved_memory(F.max("peak_rss")).alias("reserved"))


def join_spread(rows: DataFrame) -> DataFrame:
    """(last - first) / (n - 1) of the starts within a group; null for one row."""
    return rows.groupBy("run_id").agg(F.try_divide((F.max("started_at") - F.min("started_at")).cast("double"), (F.count("*") - 1).cast("double")).alias("spread"))


def doctor(runs: DataFrame, entries: DataFrame, now: int) -> DataFrame:
    """Facts as (fact, value) rows."""
    # entries that no recorded run of this store made
    orphan = entries.join(runs.where("status = 'success'").select("project", "task", "hash").distinct(), ["project", "task", "hash"], "left_anti")
    facts = [
        (runs.agg(F.countDistinct("project")), "projects"), (runs.select("project", "task").distinct().agg(F.count("*")), "tasks"), (entries.agg(F.count("*")), "entries"),
        (entries.agg(F.coalesce(F.sum("size_bytes"), F.lit(0))), "bytes"), (orphan.agg(F.count("*")), "orphans"),
        (runs.where((F.col("started_at") > now - 86_400_000) & P.hit()).agg(F.count("*")), "hits_24h"), (flaky_tasks(runs).agg(F.count("*")), "flaky"),
    ]
    out = None
    for df, name in facts:
        row = df.select(F.lit(name).alias("fact"), F.col(df.columns[0]).cast("long").alias("value"))
        out = row if out is None else out.unionByName(row)
    return out


def summary(runs: DataFrame) -> DataFrame:
    """Rows of a job summary: failures first, then by duration."""
    rank = F.when(F.col("status") == "failed", 0).when(F.col("status") == "skipped", 1).when(F.col("status") == "success", 2).otherwise(3)
    return runs.select("run_id", "id", "project", "task", "status", "duration_ms", rank.alias("rank")).orderBy("run_id", "rank", F.desc("duration_ms"), "id")


def cpu_between(before: DataFrame, after: DataFrame, children: DataFrame, own: DataFrame, most: int) -> DataFrame:
    """(tag, cpu): CPU used between two tables of processes (node, tag, cpu), by name, the `most` largest.

    A process that has ended or begun counts from or to nothing. own and all
    processes below it by children (src the child, dst its parent) are left out.
    """
    mine = affected(own, children).select("node")
    b, a = before.select("node", F.col("tag").alias("b_tag"), F.col("cpu").alias("b")), after.select("node", F.col("tag").alias("a_tag"), F.col("cpu").alias("a"))
    j = b.join(a, "node", "full").join(mine, "node", "left_anti")
    used = j.groupBy(F.coalesce("a_tag", "b_tag").alias("tag")).agg(F.sum(F.coalesce("a", F.lit(0)) - F.coalesce("b", F.lit(0))).alias("cpu"))
    return used.orderBy(F.desc("cpu"), "tag").limit(most)
