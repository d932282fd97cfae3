"""Content keys, component diffs, verdicts and retention."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import history as H
from ..operators import keys as K
from .registry import query

CHANGE = "CASE WHEN a.hash IS NULL THEN 'added' WHEN b.hash IS NULL THEN 'removed' WHEN a.hash <> b.hash THEN 'changed' END"


@query(
    "J6_component_diff",
    f"""SELECT * FROM (SELECT coalesce(a.kind, b.kind) AS kind, coalesce(a.name, b.name) AS name, {CHANGE} AS change, a.hash AS old_hash, b.hash AS new_hash
        FROM (SELECT kind, name, min(hash) AS hash FROM entry_inputs WHERE entry % 2 = 0 GROUP BY ALL) a
        FULL JOIN (SELECT kind, name, min(hash) AS hash FROM entry_inputs WHERE entry % 2 = 1 GROUP BY ALL) b ON a.kind = b.kind AND a.name = b.name) WHERE change IS NOT NULL""",
)
def j6(t):
    side = lambda k: t.entry_inputs.where(F.col("entry") % 2 == k).groupBy("kind", "name").agg(F.min("hash").alias("hash"))
    return K.diff(side(0), side(1))


@query(
    "C1_key_fold",
    """WITH RECURSIVE c AS (SELECT entry, kind, name, hash, row_number() OVER (PARTITION BY entry ORDER BY kind, name) AS n, count(*) OVER (PARTITION BY entry) AS m FROM entry_inputs),
        f AS (SELECT entry, 1 AS n, m, sha256(sha256(m::VARCHAR) || '|' || kind || '|' || name || '|' || hash) AS h FROM c WHERE n = 1
              UNION ALL SELECT f.entry, c.n, f.m, sha256(h || '|' || kind || '|' || name || '|' || hash) FROM f JOIN c ON c.entry = f.entry AND c.n = f.n + 1)
        SELECT entry, substr(h, 1, 16) AS key, m AS components FROM f WHERE n = m""",
)
def c1(t):
    return K.fold(t.entry_inputs)


@query(
    "C2_absent_inputs",
    """SELECT entry, kind, name, coalesce(CASE WHEN p_size > 5 THEN hash END, 'absent') AS hash FROM entry_inputs LEFT JOIN (SELECT p_partkey::VARCHAR AS pk, p_size FROM part) ON pk = name""",
)
def c2(t):
    part = t.table("part").where("p_size > 5").select(F.col("p_partkey").cast("string").alias("name"), F.lit(True).alias("there"))
    j = t.entry_inputs.join(part, "name", "left")
    return j.select("entry", "kind", "name", F.when(F.col("there"), F.col("hash")).otherwise("absent").alias("hash"))


@query("C3_unset_env", "SELECT id, CASE WHEN def IS NULL THEN 'DEF' ELSE 'DEF=' || def END AS folded FROM runs")
def c3(t):
    return t.runs.select("id", F.when(F.col("def").isNull(), F.lit("DEF")).otherwise(F.concat(F.lit("DEF="), "def")).alias("folded"))


@query("C4_captured", "SELECT entry, string_agg(kind || '/' || name || '=' || hash, ';' ORDER BY kind, name) AS captured FROM entry_inputs GROUP BY entry")
def c4(t):
    g = t.entry_inputs.groupBy("entry").agg(F.sort_array(F.collect_list(F.struct("kind", "name", "hash"))).alias("c"))
    return g.select("entry", F.array_join(F.transform("c", lambda x: F.concat(x["kind"], F.lit("/"), x["name"], F.lit("="), x["hash"])), ";").alias("captured"))


@query("C5_group_hash", "SELECT entry, sha256(string_agg(hash, ',' ORDER BY hash)) AS group_hash FROM entry_inputs GROUP BY entry")
def c5(t):
    return K.group_hash(t.entry_inputs)


@query(
    "C6_why_rerun",
    """WITH w AS (SELECT *, lag(hash) OVER w AS p_hash, lag(status) OVER w AS p_status, lag(def) OVER w AS p_def, lag(cache_hit) OVER w AS p_hit, lag(run_id) OVER w AS p_run FROM runs WHERE hash <> '' WINDOW w AS (PARTITION BY project, task ORDER BY id)),
       p AS (SELECT w.*, regexp_matches(i.cache_policy, ':[rw]*r') AS reads, regexp_matches(i.cache_policy, ':[rw]*w') AS writes, b.run_id IS NOT NULL AS beside, e.entry IS NOT NULL AS held
             FROM w LEFT JOIN invocations i ON i.run_id = w.run_id LEFT JOIN (SELECT run_id FROM invocations WHERE failed_count > 0 AND regexp_matches(cache_policy, ':[rw]*w')) b ON b.run_id = w.p_run
             LEFT JOIN entries e ON e.project = w.project AND e.task = w.task AND e.hash = w.hash)
       SELECT id, project, task, CASE WHEN cache_hit THEN 'hit' WHEN status = 'skipped' THEN 'skipped' WHEN p_hash IS NULL THEN 'first-run' WHEN cached IS NULL THEN 'not-cached'
         WHEN def <> p_def THEN 'definition-changed' WHEN hash <> p_hash THEN 'inputs-changed' WHEN cache_hit IS NULL THEN 'not-recorded' WHEN p_status = 'failed' THEN 'retry-after-failure' WHEN NOT reads AND writes THEN 'cache-not-read' WHEN NOT reads THEN 'cache-not-used'
         WHEN status = 'success' AND p_status = 'success' AND p_hit IS false AND beside THEN 'beside-a-failure' WHEN NOT held THEN 'entry-gone' ELSE 'same-key' END AS verdict FROM p""",
)
def c6(t):
    return K.why_rerun(t.runs, t.invocations, t.entries)


@query(
    "C7_key_diffs",
    """WITH p AS (SELECT o_orderkey AS new, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS old FROM orders),
        q AS (SELECT * FROM p WHERE old IS NOT NULL),
        a AS (SELECT old, new, kind, name, hash FROM q JOIN entry_inputs ON entry = old), b AS (SELECT old, new, kind, name, hash FROM q JOIN entry_inputs ON entry = new)
        SELECT coalesce(a.old, b.old) AS old, coalesce(a.new, b.new) AS new, count(*) FILTER (WHERE a.hash IS NULL) AS added, count(*) FILTER (WHERE b.hash IS NULL) AS removed,
          count(*) FILTER (WHERE a.hash <> b.hash) AS changed, count(*) FILTER (WHERE a.hash = b.hash) AS unchanged
        FROM a FULL JOIN b ON a.old = b.old AND a.new = b.new AND a.kind = b.kind AND a.name = b.name GROUP BY 1, 2""",
)
def c7(t):
    from pyspark.sql import Window

    old = F.lag("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    pairs = t.table("orders").select(F.col("o_orderkey").alias("new"), old.alias("old")).where("old IS NOT NULL")
    return K.diff_counts(pairs, t.entry_inputs)


HELD = "SELECT entry::VARCHAR AS entry, kind, name, hash FROM entry_inputs JOIN orders ON o_orderkey = entry WHERE o_orderstatus <> 'F'"


@query(
    "C7b_run_key_diffs",
    f"""WITH comp AS ({HELD}), keys AS (SELECT DISTINCT entry FROM comp),
        x AS (SELECT r.id, r.project, r.task, r.run_id, r.hash, r.status, r.cached IS NOT DISTINCT FROM false AS uncached, r.status IN ('success', 'cache-hit', 'cache-hit-remote') AS ok, k.entry IS NOT NULL AS held,
                regexp_matches(i.cache_policy, ':[rw]*w') AS writes, regexp_matches(i.cache_policy, ':[rw]*w') AND i.failed_count > 0 AS beside
              FROM runs r JOIN invocations i ON i.run_id = r.run_id LEFT JOIN keys k ON k.entry = r.hash WHERE r.hash <> ''),
        fetched AS (SELECT DISTINCT project, task, hash FROM x WHERE status = 'cache-hit-remote'),
        y AS (SELECT *, lag(run_id) OVER w AS p_run, lag(hash) OVER w AS p_hash, lag(ok) OVER w AS p_ok, lag(held) OVER w AS p_held, lag(writes) OVER w AS p_writes, lag(beside) OVER w AS p_beside,
                last_value(CASE WHEN held THEN run_id END IGNORE NULLS) OVER v AS s_run, last_value(CASE WHEN held THEN hash END IGNORE NULLS) OVER v AS s_hash
              FROM x WINDOW w AS (PARTITION BY project, task ORDER BY id), v AS (PARTITION BY project, task ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        z AS (SELECT *, CASE WHEN NOT p_ok THEN 'previous-ended' WHEN p_beside THEN 'previous-beside-a-failure' WHEN NOT p_writes THEN 'previous-not-written' END AS unsaved FROM y),
        n AS (SELECT *, CASE WHEN p_hash IS NULL THEN 'first' WHEN p_hash = hash THEN 'same-key' WHEN held AND NOT p_held AND unsaved IS NOT NULL AND s_run IS NOT NULL THEN 'since-saved' WHEN NOT held OR NOT p_held THEN 'unavailable' ELSE 'previous' END AS note FROM z),
        o AS (SELECT *, CASE note WHEN 'since-saved' THEN s_hash WHEN 'previous' THEN p_hash END AS old FROM n),
        q AS (SELECT DISTINCT old, hash AS new FROM o WHERE old IS NOT NULL),
        a AS (SELECT old, new, kind, name, hash FROM q JOIN comp ON entry = old), b AS (SELECT old, new, kind, name, hash FROM q JOIN comp ON entry = new),
        d AS (SELECT coalesce(a.old, b.old) AS old, coalesce(a.new, b.new) AS new, count(*) FILTER (WHERE a.hash IS NULL) AS added, count(*) FILTER (WHERE b.hash IS NULL) AS removed, count(*) FILTER (WHERE a.hash <> b.hash) AS changed, count(*) FILTER (WHERE a.hash = b.hash) AS unchanged
              FROM a FULL JOIN b ON a.old = b.old AND a.new = b.new AND a.kind = b.kind AND a.name = b.name GROUP BY 1, 2)
       SELECT o.id, o.project, o.task, o.run_id, CASE WHEN note = 'since-saved' THEN s_run ELSE p_run END AS since, note,
         CASE WHEN note = 'since-saved' THEN unsaved WHEN note <> 'unavailable' THEN NULL WHEN uncached THEN 'uncached' WHEN NOT held AND NOT ok THEN 'ended' WHEN NOT held AND NOT writes THEN 'not-written' WHEN NOT held AND beside THEN 'beside-a-failure'
           WHEN NOT p_held AND unsaved IS NOT NULL THEN unsaved
           WHEN (NOT held AND EXISTS (SELECT 1 FROM fetched f WHERE f.project = o.project AND f.task = o.task AND f.hash = o.hash)) OR (NOT p_held AND EXISTS (SELECT 1 FROM fetched f WHERE f.project = o.project AND f.task = o.task AND f.hash = o.p_hash)) THEN 'remote' ELSE 'gone' END AS why,
         coalesce(d.added, 0) AS added, coalesce(d.removed, 0) AS removed, coalesce(d.changed, 0) AS changed, coalesce(d.unchanged, 0) AS unchanged
       FROM o LEFT JOIN d ON d.old = o.old AND d.new = o.hash
       UNION ALL SELECT id, project, task, run_id, NULL, 'no-key', NULL, 0, 0, 0, 0 FROM runs WHERE hash = ''""",
)
def c7b(t):
    # the entries of finished orders are gone
    open_ = t.table("orders").where("o_orderstatus <> 'F'").select(F.col("o_orderkey").alias("entry"))
    held = t.entry_inputs.join(open_, "entry", "left_semi").withColumn("entry", F.col("entry").cast("string"))
    return K.run_key_diffs(t.runs, t.invocations, held)


@query(
    "C8_explained_misses",
    """WITH p AS (SELECT o_orderkey AS new, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS old FROM orders), q AS (SELECT * FROM p WHERE old IS NOT NULL),
        a AS (SELECT old, new, kind, name, hash FROM q JOIN entry_inputs ON entry = old), b AS (SELECT old, new, kind, name, hash FROM q JOIN entry_inputs ON entry = new),
        d AS (SELECT coalesce(a.old, b.old) AS old, coalesce(a.new, b.new) AS new, coalesce(a.kind, b.kind) AS kind, coalesce(a.name, b.name) AS name
              FROM a FULL JOIN b ON a.old = b.old AND a.new = b.new AND a.kind = b.kind AND a.name = b.name WHERE a.hash IS DISTINCT FROM b.hash),
        n AS (SELECT *, row_number() OVER (PARTITION BY old, new ORDER BY kind, name) AS k FROM d)
       SELECT old, new, count(*) AS moved, string_agg(kind || ':' || name, ',' ORDER BY k) FILTER (WHERE k <= 3) AS shown FROM n GROUP BY old, new""",
)
def c8(t):
    from pyspark.sql import Window

    old = F.lag("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    pairs = t.table("orders").select(F.col("o_orderkey").alias("new"), old.alias("old")).where("old IS NOT NULL")
    return K.explained_misses(pairs, t.entry_inputs, first=3)


@query("C9_prune_by_age", "SELECT entry, size_bytes FROM entries WHERE accessed_at < 1705000000000")
def c9(t):
    return t.entries.where("accessed_at < 1705000000000").select("entry", "size_bytes")


@query(
    "C9b_pruned",
    """WITH o AS (SELECT *, accessed_at < 1705000000000 AS old FROM entries), s AS (SELECT entry, size_bytes, old, sum(size_bytes) FILTER (WHERE NOT old) OVER () - coalesce(sum(size_bytes) FILTER (WHERE NOT old) OVER (ORDER BY accessed_at, entry ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS left_ FROM o)
       SELECT entry, size_bytes, CASE WHEN old THEN 'age' ELSE 'size' END AS why FROM s WHERE old OR left_ > 2000000""",
)
def c9b(t):
    return K.pruned(t.entries, before=1_705_000_000_000, most_bytes=2_000_000)[0]


@query(
    "C9c_kept",
    """WITH o AS (SELECT * FROM entries WHERE accessed_at >= 1705000000000), s AS (SELECT entry, size_bytes, sum(size_bytes) OVER () - coalesce(sum(size_bytes) OVER (ORDER BY accessed_at, entry ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS left_ FROM o)
       SELECT count(*) AS kept, coalesce(sum(size_bytes), 0)::BIGINT AS bytes, (SELECT count(*) FROM entries) AS dry FROM s WHERE left_ <= 2000000""",
)
def c9c(t):
    # a dry run names the same entries and keeps all
    kept, dry = (K.pruned(t.entries, before=1_705_000_000_000, most_bytes=2_000_000, dry=dry)[1] for dry in (False, True))
    return kept.agg(F.count("*").alias("kept"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("bytes")).crossJoin(F.broadcast(dry.agg(F.count("*").alias("dry"))))


@query("C10_without_orphans", "SELECT id, project, task, hash FROM runs WHERE hash <> '' AND EXISTS (SELECT 1 FROM entries e WHERE e.entry = runs.project || '#' || runs.task || '#' || runs.hash AND e.accessed_at >= 1705000000000)")
def c10(t):
    parents = t.entries.where("accessed_at >= 1705000000000")
    children = t.runs.where("hash <> ''").withColumn("entry", F.concat_ws("#", "project", "task", "hash"))
    return H.without_orphans(children, parents, "entry").select("id", "project", "task", "hash")


AGED = {"runs": "started_at", "invocations": "started_at", "steps": "started_at", "warnings": "started_at", "failures": "started_at", "task_durations": "started_at", "task_outcomes": "started_at", "remote_hits": "started_at"}


@query(
    "C11_retention",
    " UNION ALL ".join(f"SELECT '{name}' AS relation, count(*) AS kept FROM {name} WHERE {at} >= 1705000000000" for name, at in AGED.items())
    + " UNION ALL SELECT 'run_ids', count(*) FROM (SELECT DISTINCT run_id FROM runs WHERE started_at >= 1705000000000)",
)
def c11(t):
    kept = H.retained_relations({name: getattr(t, name) for name in AGED}, AGED, 1_705_000_000_000)
    # the dictionary keeps the ids that a kept row still uses
    kept["run_ids"] = H.without_orphans(t.invocations.select("run_id"), kept["runs"], "run_id")
    out = None
    for name, rows in kept.items():
        n = rows.agg(F.count("*").alias("kept")).select(F.lit(name).alias("relation"), "kept")
        out = n if out is None else out.unionByName(n)
    return out


@query(
    "C12_batched_lookup",
    "SELECT k.key, e.size_bytes, e.entry IS NOT NULL AS held FROM (SELECT DISTINCT project || '#' || task || '#' || hash AS key FROM runs WHERE id % 3 = 0 OR status = 'failed') k LEFT JOIN entries e ON e.entry = k.key",
)
def c12(t):
    # every key that a third of the runs and all failed ones ask for, in one statement
    asked = t.runs.where("id % 3 = 0 OR status = 'failed'").select(F.concat_ws("#", "project", "task", "hash").alias("key")).distinct()
    held = t.entries.select(F.col("entry").alias("key"), "size_bytes", F.lit(True).alias("held"))
    return asked.join(held, "key", "left").select("key", "size_bytes", F.coalesce("held", F.lit(False)).alias("held"))


@query("J15_newest_entry_inputs", "SELECT o_custkey, max(o_orderkey) AS entry, kind, count(*) AS n FROM (SELECT o_custkey, max(o_orderkey) AS o_orderkey FROM orders GROUP BY 1) JOIN entry_inputs ON entry = o_orderkey GROUP BY o_custkey, kind")
def j15(t):
    newest = t.table("orders").groupBy("o_custkey").agg(F.max("o_orderkey").alias("entry"))
    return newest.join(t.entry_inputs, "entry").groupBy("o_custkey", "entry", "kind").agg(F.count("*").alias("n"))

