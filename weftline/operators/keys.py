"""Content keys: fold, component diff, and why a task ran again."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import predicates as P
from ..sources.shared import written
from .timeline import evicted, neighbour, neighbours


def fold(components: DataFrame, length: int = 16) -> DataFrame:
    """(entry, key): a chain of digests over an entry's components in (kind, name) order; a missing hash folds as 'absent'.

    Keys only have to be stable here, so SHA-256 stands in for other hashes.
    """
    parts = F.sort_array(F.collect_list(F.struct("kind", "name", F.coalesce("hash", F.lit("absent")).alias("hash"))))
    rows = components.groupBy("entry").agg(parts.alias("c"))
    key = F.aggregate("c", F.sha2(F.size("c").cast("string"), 256), lambda h, x: F.sha2(F.concat_ws("|", h, x["kind"], x["name"], x["hash"]), 256))
    return rows.select("entry", F.substring(key, 1, length).alias("key"), F.size("c").cast("long").alias("components"))


def group_hash(components: DataFrame) -> DataFrame:
    rows = components.groupBy("entry").agg(F.array_join(F.sort_array(F.collect_list("hash")), ",").alias("h"))
    return rows.select("entry", F.sha2("h", 256).alias("group_hash"))


def diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(kind, name, change, old_hash, new_hash) of the components that differ, in (kind, name) order."""
    a = old.select("kind", "name", F.col("hash").alias("old_hash"))
    b = new.select("kind", "name", F.col("hash").alias("new_hash"))
    change = F.when(F.col("old_hash").isNull(), "added").when(F.col("new_hash").isNull(), "removed").when(F.col("old_hash") != F.col("new_hash"), "changed")
    return a.join(b, ["kind", "name"], "full").withColumn("change", change).where("change IS NOT NULL").select("kind", "name", "change", "old_hash", "new_hash").orderBy("kind", "name")


MOVES = ("added", "removed", "changed", "unchanged")


def diff_counts(pairs: DataFrame, components: DataFrame) -> DataFrame:
    """Of each (old, new) pair of entries: how many components were added, removed, changed and kept."""
    c = components.select("entry", "kind", "name", "hash")
    a = pairs.join(c.withColumnRenamed("entry", "old"), "old").select("old", "new", "kind", "name", F.col("hash").alias("a"))
    b = pairs.join(c.withColumnRenamed("entry", "new"), "new").select("old", "new", "kind", "name", F.col("hash").alias("b"))
    n = lambda cond: F.count(F.when(cond, 1))
    both = a.join(b, ["old", "new", "kind", "name"], "full")
    return both.groupBy("old", "new").agg(n(F.col("a").isNull()).alias("added"), n(F.col("b").isNull()).alias("removed"), n(F.col("a") != F.col("b")).alias("changed"), n(F.col("a") == F.col("b")).alias("unchanged"))


def why_rerun(runs: DataFrame, invocations: DataFrame, entries: DataFrame) -> DataFrame:
    """Why each executed keyed row ran: the first case that holds against the task's keyed row before.

    An unchanged key ends in one of several ways, told apart by what is on
    record: nothing recorded, a failure before it, a policy that doesn't read
    (and writes, or not), a run beside a failed task, which isn't saved, and
    an entry that is gone.
    """
    before = F.struct("hash", "status", "def", "cache_hit", F.col("run_id").alias("run"))
    prev = neighbour(runs.where("hash <> ''"), before, "project", "task")
    prev = prev.withColumns({"p_hash": F.col("_near.hash"), "p_status": F.col("_near.status"), "p_def": F.col("_near.def"), "p_hit": F.col("_near.cache_hit"), "p_run": F.col("_near.run")})
    policy = invocations.select("run_id", P.policy_allows("cache_policy", "(?:local|remote)", "r").alias("reads"), P.policy_allows("cache_policy", "(?:local|remote)", "w").alias("writes"))
    beside = invocations.where((F.col("failed_count") > 0) & P.policy_allows("cache_policy", "(?:local|remote)", "w")).select(F.col("run_id").alias("p_run"), F.lit(True).alias("beside"))
    held = entries.select("project", "task", "hash", F.lit(True).alias("held")).distinct()
    prev = prev.join(policy, "run_id", "left").join(beside, "p_run", "left").join(held, ["project", "task", "hash"], "left")
    verdict = (
        F.when(F.col("cache_hit"), "hit").when(F.col("status") == "skipped", "skipped").when(F.col("p_hash").isNull(), "first-run").when(F.col("cached").isNull(), "not-cached")
        .when(F.col("def").isNotNull() & F.col("p_def").isNotNull() & (F.col("def") != F.col("p_def")), "definition-changed").when(F.col("hash") != F.col("p_hash"), "inputs-changed")
        .when(F.col("cache_hit").isNull(), "not-recorded").when(F.col("p_status") == "failed", "retry-after-failure").when(~F.col("reads") & F.col("writes"), "cache-not-read").when(~F.col("reads"), "cache-not-used")
        .when((F.col("status") == "success") & (F.col("p_status") == "success") & ~F.col("p_hit") & F.col("beside"), "beside-a-failure").when(F.col("held").isNull(), "entry-gone").otherwise("same-key")
    )
    return prev.select("id", "project", "task", verdict.alias("verdict"))


def run_key_diffs(runs: DataFrame, invocations: DataFrame, components: DataFrame) -> DataFrame:
    """Beside each row of runs: the run its key is compared with, how many components moved since, and why none can be named.

    components: (entry, kind, name, hash), entry being the key of runs. note
    is no-key, first, same-key, previous (compared with the task's keyed row
    before), since-saved (that row failed, ran beside a failure or didn't
    write the cache, so it kept no components, and the last row before that
    kept some takes its place) or unavailable. why is then what the row
    before, or this one, lacked: uncached, ended, not-written,
    beside-a-failure, each with `previous-` if it is the row before that
    lacks it, remote (a remote entry carries no components) or gone.
    Components are compared once for each pair of keys, and only those of keys
    that runs have are read. What is known of a key is looked up once for each
    task that has it; a row takes it along as what the row after it asks.
    """
    writes = P.policy_allows("cache_policy", "(?:local|remote)", "w")
    kept = written(invocations.select("run_id", writes.alias("writes"), (writes & (F.col("failed_count") > 0)).alias("beside")))
    rows = runs.select("id", "project", "task", "run_id", F.coalesce("hash", F.lit("")).alias("hash"), P.passed().alias("ok"), F.col("cached").eqNullSafe(F.lit(False)).alias("uncached"), (F.col("status") == "cache-hit-remote").alias("remote"))
    bare = rows.where("hash = ''").select("id", "project", "task", "run_id", F.lit(None).cast("string").alias("since"), F.lit("no-key").alias("note"), F.lit(None).cast("string").alias("why"), *[F.lit(0).cast("long").alias(c) for c in MOVES])
    rows = rows.where("hash <> ''")
    keys = written(rows.groupBy("project", "task", "hash").agg(F.max("remote").alias("fetched")))
    components = written(components.select("entry", "kind", "name", "hash").join(written(keys.select(F.col("hash").alias("entry")).distinct()), "entry", "left_semi"))
    keys = written(keys.join(components.select(F.col("entry").alias("hash"), F.lit(True).alias("held")).distinct(), "hash", "left"))
    rows = rows.drop("remote").join(keys, ["project", "task", "hash"], "left").join(kept, "run_id", "left")
    rows = written(rows.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("held", "fetched", "writes", "beside")}))
    near = {"p": F.struct("run_id", "hash", "ok", "held", "fetched", "writes", "beside"), "s": F.when(F.col("held"), F.struct("run_id", "hash"))}
    rows = neighbours(rows, near, "project", "task")
    p = lambda c: F.col(f"p.{c}")
    unsaved = F.when(~p("ok"), "previous-ended").when(p("beside"), "previous-beside-a-failure").when(~p("writes"), "previous-not-written")
    rows = rows.withColumn("unsaved", unsaved)
    note = (
        F.when(F.col("p").isNull(), "first").when(p("hash") == F.col("hash"), "same-key")
        .when(F.col("held") & ~p("held") & F.col("unsaved").isNotNull() & F.col("s").isNotNull(), "since-saved").when(~F.col("held") | ~p("held"), "unavailable").otherwise("previous")
    )
    rows = rows.withColumn("note", note).withColumn("since", F.when(F.col("note") == "since-saved", F.col("s.run_id")).otherwise(p("run_id")))
    rows = rows.withColumn("old", F.when(F.col("note") == "since-saved", F.col("s.hash")).when(F.col("note") == "previous", p("hash")))
    # a key of the two that lacks components may have been fetched by the task
    remote = (~F.col("held") & F.col("fetched")) | (~p("held") & p("fetched"))
    why = (
        F.when(F.col("uncached"), "uncached").when(~F.col("held") & ~F.col("ok"), "ended").when(~F.col("held") & ~F.col("writes"), "not-written").when(~F.col("held") & F.col("beside"), "beside-a-failure")
        .when(~p("held") & F.col("unsaved").isNotNull(), F.col("unsaved")).when(remote, "remote").otherwise("gone")
    )
    rows = rows.withColumn("why", F.when(F.col("note") == "unavailable", why).when(F.col("note") == "since-saved", F.col("unsaved")))
    rows = written(rows.select("id", "project", "task", "run_id", "since", "note", "why", "old", "hash"))
    moved = written(diff_counts(rows.where("old IS NOT NULL").select("old", F.col("hash").alias("new")).distinct(), components))
    out = rows.join(moved.withColumnRenamed("new", "hash"), ["old", "hash"], "left")
    return out.select("id", "project", "task", "run_id", "since", "note", "why", *[F.coalesce(c, F.lit(0)).alias(c) for c in MOVES]).unionByName(bare)


def explained_misses(pairs: DataFrame, components: DataFrame, first: int = 10) -> DataFrame:
    """Of each (old, new) pair of entries that differ: how many components moved, and the first few by kind and name."""
    c = components.select("entry", "kind", "name", "hash")
    a = pairs.join(c.withColumnRenamed("entry", "old"), "old").select("old", "new", "kind", "name", F.col("hash").alias("a"))
    b = pairs.join(c.withColumnRenamed("entry", "new"), "new").select("old", "new", "kind", "name", F.col("hash").alias("b"))
    moved = a.join(b, ["old", "new", "kind", "name"], "full").where(~F.col("a").eqNullSafe(F.col("b")))
    n = F.row_number().over(Window.partitionBy("old", "new").orderBy("kind", "name"))
    few = F.array_sort(F.collect_list(F.when(F.col("n") <= first, F.struct("n", F.concat_ws(":", "kind", "name").alias("c")))))
    return moved.withColumn("n", n).groupBy("old", "new").agg(F.count("*").alias("moved"), few.alias("few")).select("old", "new", "moved", F.array_join(F.col("few.c"), ",").alias("shown"))


def pruned(entries: DataFrame, before: int, most_bytes: int, dry: bool = False) -> tuple[DataFrame, DataFrame]:
    """What a prune takes (entry, size_bytes, why), and the entries it leaves.

    First what was last used before a moment, by age; of the rest the oldest
    until at most most_bytes stay, by size. A dry run takes the same and
    leaves everything.
    """
    aged = entries.where(F.col("accessed_at") < before)
    rest = entries.where(F.col("accessed_at") >= before)
    sized = evicted(rest, most_bytes)
    gone = aged.select("entry", "size_bytes", F.lit("age").alias("why")).unionByName(sized.select("entry", "size_bytes", F.lit("size").alias("why")))
    return gone, entries if dry else entries.join(gone.select("entry"), "entry", "left_anti")
