"""Scans, predicates, statistics, scalars and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import measures as M
from ..functions import predicates as P
from ..functions import text as X
from ..operators import history as H
from ..operators import stats as S
from ..operators.ask import ask
from ..sources.bindings import RELATIONS
from .registry import query

#: A moment inside the test data, in epoch milliseconds: 2024-01-20.
NOW = 1_705_708_800_000
PASS = "status IN ('success', 'cache-hit', 'cache-hit-remote')"
HIT = "status IN ('cache-hit', 'cache-hit-remote')"
COLUMNS = "id, project, task, hash, status, duration_ms, run_id"


def _cols(df, names: str = COLUMNS):
    return df.select(*names.split(", "))


@query("S1_list_runs", f"SELECT {COLUMNS} FROM runs WHERE project = 'p3' ORDER BY id DESC LIMIT 100")
def s1(t):
    return _cols(H.list_runs(t.runs, 100, project="p3"))


@query("S2_list_invocations", "SELECT * FROM invocations ORDER BY run_id DESC LIMIT 50")
def s2(t):
    return H.list_invocations(t.invocations, 50)


@query("S3_get_invocation", "SELECT * FROM invocations WHERE run_id = '2024010512'")
def s3(t):
    return t.invocations.where("run_id = '2024010512'")


@query("S4_run_rows", f"SELECT {COLUMNS}, min(started_at) OVER () AS run_start, max(ended_at) OVER () AS run_end FROM runs WHERE run_id = '2024010512'")
def s4(t):
    return _cols(H.run_rows(t.runs, "2024010512"), COLUMNS + ", run_start, run_end")


@query(
    "S5_window_floor",
    """SELECT CAST(CASE WHEN (SELECT count(*) FROM (SELECT 1 FROM invocations LIMIT 50)) < 50 THEN 0
         ELSE (SELECT min(id) FROM runs WHERE run_id IN (SELECT run_id FROM invocations ORDER BY run_id DESC LIMIT 50)) END AS BIGINT) AS floor""",
)
def s5(t):
    return H.window_floor(t.runs, t.invocations, 50)


@query("S6_latest_run", "SELECT project, task, arg_max(run_id, id) AS run_id FROM runs GROUP BY project, task")
def s6(t):
    return H.latest_run(t.runs)


@query(
    "S7_resolve_prefix",
    """WITH h AS (SELECT run_id FROM invocations WHERE run_id >= '202401051' AND run_id < '202401051~')
       SELECT CASE WHEN bool_or(run_id = '202401051') THEN 'exact' WHEN count(*) = 1 THEN 'unique' WHEN count(*) > 1 THEN 'ambiguous' ELSE 'none' END AS verdict,
              count(*) AS matches, (SELECT coalesce(string_agg(run_id, ',' ORDER BY run_id), '') FROM (SELECT run_id FROM h ORDER BY run_id LIMIT 5)) AS shown FROM h""",
)
def s7(t):
    return H.resolve_prefix(t.invocations, "202401051")


@query(
    "S8_shortest_prefix",
    """SELECT a.run_id, substr(a.run_id, 1, greatest(6, max(CASE WHEN b.run_id IS NULL THEN 0 ELSE
         (SELECT max(i) FROM range(0, 11) r(i) WHERE substr(a.run_id, 1, i) = substr(b.run_id, 1, i)) + 1 END))::INT) AS prefix
       FROM invocations a LEFT JOIN invocations b ON a.run_id <> b.run_id GROUP BY a.run_id""",
)
def s8(t):
    return H.shortest_prefix(t.invocations.select("run_id"), 6)


@query("S9_json_keys", "SELECT id, unnest(range(0, 3)) AS pos, unnest([project, task, hash]) AS key FROM runs")
def s9(t):
    # any number of keys in one JSON text, as rows
    keys = t.runs.select("id", F.to_json(F.array("project", "task", "hash")).alias("keys"))
    return keys.select("id", F.posexplode(F.from_json("keys", "array<string>")).alias("pos", "key")).select("id", F.col("pos").cast("long").alias("pos"), "key")


@query(
    "S14_manifest_edges",
    """SELECT node, 'order' AS kind, 'n' || unnest(list_distinct([node // 2, node // 5, node // 7])) AS dep FROM nodes WHERE node >= 1
       UNION ALL SELECT node, 'reach', 'n' || (node // 3) FROM nodes WHERE node >= 1 AND node // 3 NOT IN (node // 2, node // 5, node // 7)""",
)
def s14(t):
    # dependencies of all three lists give the order; peers only reach, unless they are among those
    lists = {"dependencies": 2, "devDependencies": 5, "optionalDependencies": 7, "peerDependencies": 3}
    manifest = F.format_string("{" + ",".join(f'"{name}":{{"n%d":"*"}}' for name in lists) + "}", *[F.expr(f"node div {d}") for d in lists.values()])
    m = t.nodes.where("node >= 1").select("node", F.from_json(manifest, f"struct<{','.join(f'{name}:map<string,string>' for name in lists)}>").alias("m"))
    first, second, third, peers = (F.map_keys(f"m.{name}") for name in lists)
    order = F.array_union(F.array_union(first, second), third)
    deps = lambda kind, names: m.select("node", F.lit(kind).alias("kind"), F.explode(names).alias("dep"))
    return deps("order", order).unionByName(deps("reach", F.array_except(peers, order)))


@query("S15_timings_file", "SELECT project || '#' || task AS id, CAST(max(duration_ms) AS DOUBLE) AS ms FROM runs GROUP BY ALL HAVING max(duration_ms) % 2 = 0")
def s15(t):
    # odd values are written negative, which a reader has to drop
    g = t.runs.groupBy(F.concat_ws("#", "project", "task").alias("id")).agg(F.max("duration_ms").alias("d"))
    text = g.select(F.to_json(F.create_map("id", F.expr("IF(d % 2 = 0, d, -d)").cast("double"))).alias("j"))
    tasks = text.select(F.explode(F.from_json("j", "map<string,double>")).alias("id", "ms"))
    return tasks.where(P.measured("ms"))


@query("S17_timing_lookup", "SELECT hash, max(size_bytes) AS duration_ms FROM entries WHERE hash IN ('1', '2', '3', '50') GROUP BY hash")
def s17(t):
    asked = t.spark.createDataFrame([("1",), ("2",), ("3",), ("50",), ("none",)], "hash string")
    return t.entries.join(F.broadcast(asked), "hash").groupBy("hash").agg(F.max("size_bytes").alias("duration_ms"))


@query("S18_newest_failed", "SELECT * FROM invocations WHERE NOT exit_ok ORDER BY run_id DESC LIMIT 10")
def s18(t):
    return H.list_invocations(t.invocations, 10, failed_only=True)


@query("K2_insert_or_ignore", "SELECT project, task, hash, CASE WHEN hash < '5' THEN size_bytes ELSE -1 END AS size_bytes FROM entries")
def k2(t):
    # the import brings every entry again with another size: rows that are present stay as they are
    e = t.entries.select("project", "task", "hash", "size_bytes")
    return H.insert_or_ignore(e.where("hash < '5'"), e.withColumn("size_bytes", F.lit(-1).cast("long")), "project", "task", "hash")


@query("K5_remote_errors", "SELECT id, CASE WHEN status = 'failed' THEN 'E' || (id % 5) ELSE def END AS note FROM runs")
def k5(t):
    new = t.runs.where("status = 'failed'").select("id", F.concat(F.lit("E"), F.expr("id % 5")).alias("error"))
    return t.runs.join(new, "id", "left").select("id", F.coalesce("error", "def").alias("note"))


@query("K6_newest_runs_kept", "SELECT id, run_id FROM runs WHERE run_id IN (SELECT DISTINCT run_id FROM runs ORDER BY run_id DESC LIMIT 50) AND status = 'failed'")
def k6(t):
    return H.keep_newest_runs(t.runs, 50).where("status = 'failed'").select("id", "run_id")


@query(
    "K7_timings_overlay",
    """SELECT coalesce(a.k, b.k) AS id, coalesce(b.v, a.v) AS ms
       FROM (SELECT project || '#' || task AS k, max(duration_ms) AS v FROM runs WHERE id % 2 = 0 GROUP BY 1) a
       FULL JOIN (SELECT project || '#' || task AS k, max(duration_ms) AS v FROM runs WHERE id % 3 = 0 AND status = 'success' GROUP BY 1) b ON a.k = b.k""",
)
def k7(t):
    k = F.concat_ws("#", "project", "task").alias("id")
    old = t.runs.where("id % 2 = 0").groupBy(k).agg(F.max("duration_ms").alias("old"))
    new = t.runs.where("id % 3 = 0 AND status = 'success'").groupBy(k).agg(F.max("duration_ms").alias("new"))
    return old.join(new, "id", "full").select("id", F.coalesce("new", "old").alias("ms")).orderBy("id")


@query(
    "K8_metric_points",
    """SELECT run_id, name, CAST(value AS DOUBLE) AS value FROM (SELECT run_id, task_count, failed_count, ended_at - started_at AS wall_ms FROM invocations)
       UNPIVOT (value FOR name IN (task_count, failed_count, wall_ms))""",
)
def k8(t):
    i = t.invocations.withColumn("wall_ms", F.col("ended_at") - F.col("started_at"))
    names = ["task_count", "failed_count", "wall_ms"]
    return i.select("run_id", *[F.col(n).cast("double").alias(n) for n in names]).unpivot("run_id", names, "name", "value")


@query("K9_job_summary", "SELECT run_id, id, project, task, status, duration_ms, CASE status WHEN 'failed' THEN 0 WHEN 'skipped' THEN 1 WHEN 'success' THEN 2 ELSE 3 END AS rank FROM runs")
def k9(t):
    return S.summary(t.runs)


@query("K10_json_rows", """SELECT id, '{"id":' || id || ',"project":"' || project || '","ok":' || CASE WHEN status = 'failed' THEN 'false' ELSE 'true' END || '}' AS json FROM runs""")
def k10(t):
    return t.runs.select("id", F.to_json(F.struct("id", "project", (F.col("status") != "failed").alias("ok"))).alias("json"))


for _name, _predicate, _where in (
    ("P1_executed", P.executed, "status <> 'skipped'"),
    ("P2_keyed", P.keyed, "hash <> ''"),
    ("P3_passed", P.passed, PASS),
    ("P5_observes_key", P.observes_key, "hash <> '' AND cached IS DISTINCT FROM false AND blocked_by IS NULL"),
    ("P6_current_definition", lambda: F.col("def").isNull() | (F.col("def") == "d1"), "def IS NULL OR def = 'd1'"),
    ("P7_keyed_outcome", lambda: P.keyed() & P.not_uncached() & F.col("blocked_by").isNull(), "hash <> '' AND cached IS NOT false AND blocked_by IS NULL"),
):
    query(_name, f"SELECT id, project, status FROM runs WHERE {_where}")(lambda t, p=_predicate: t.runs.where(p()).select("id", "project", "status"))


@query("P4_cache_source", "SELECT id, CASE status WHEN 'cache-hit' THEN 'local' WHEN 'cache-hit-remote' THEN 'remote' WHEN 'skipped' THEN 'none' ELSE 'miss' END AS source FROM runs")
def p4(t):
    return t.runs.select("id", P.cache_source().alias("source"))


@query("P8_name_glob", "SELECT node, name FROM projects WHERE regexp_full_match(name, '@s.*/lib-.*4')")
def p8(t):
    return t.projects.where(P.glob("name", "@s*/lib-*4")).select("node", "name")


@query("P9_task_pattern", "SELECT id, project || '#' || task AS task_id FROM runs WHERE regexp_full_match(project || '#' || task, 'p1.*#t[0-9]') AND task = 't2'")
def p9(t):
    return t.runs.select("id", F.concat_ws("#", "project", "task").alias("task_id")).where(P.glob("task_id", "p1*#t2"))


@query("P10_path_glob", "SELECT node, dir FROM projects WHERE regexp_full_match(dir, 'packages/(?:[^/]+/)*p1[^/]*')")
def p10(t):
    return t.projects.where(P.path_glob("dir", "packages/**/p1*")).select("node", "dir")


@query("P11_at_or_under", "SELECT node, dir FROM projects WHERE dir = 'packages/b3' OR starts_with(dir, 'packages/b3/')")
def p11(t):
    return t.projects.where(P.at_or_under("dir", "packages/b3")).select("node", "dir")


@query("P12_any_tag", "SELECT node FROM projects WHERE len(list_filter(tags, lambda x: starts_with(x, 'Brand#1'))) > 0")
def p12(t):
    return t.projects.where(P.any_tag("tags", "Brand#1*")).select("node")


@query("P14_measured", "SELECT id FROM runs WHERE duration_ms % 3 <> 0")
def p14(t):
    x = F.expr("CASE duration_ms % 3 WHEN 0 THEN IF(id % 2 = 0, double('NaN'), -1.0D) ELSE double(duration_ms) END")
    return t.runs.withColumn("x", x).where(P.measured("x")).select("id")


@query("P15_policy", "SELECT run_id, regexp_matches(cache_policy, '(^|,)remote:r?w') AS writes, regexp_matches(cache_policy, '(^|,)remote:r') AS reads FROM invocations")
def p15(t):
    return t.invocations.select("run_id", P.policy_allows("cache_policy", "remote", "w").alias("writes"), P.policy_allows("cache_policy", "remote", "r").alias("reads"))


@query("P16_masked", "SELECT id, CASE WHEN id % 2 = 0 AND id % 3 = 0 THEN '***' ELSE hash END AS value FROM runs")
def p16(t):
    r = t.runs.select("id", F.expr("IF(id % 2 = 0, 'env', 'file')").alias("kind"), F.expr("IF(id % 3 = 0, 'API_TOKEN', 'PATH')").alias("name"), "hash")
    return r.select("id", P.masked("kind", "name", "hash").alias("value"))


@query("P17_renamed", "SELECT id AS \"rowId\", cached AS \"isCached\", CAST(cached AS INTEGER) AS \"cachedFlag\" FROM runs")
def p17(t):
    return t.runs.select(F.col("id").alias("rowId"), F.col("cached").alias("isCached"), F.col("cached").cast("int").alias("cachedFlag"))


STATS_SQL = f"""
SELECT KEYS, total, successes, hits, failures, retried, s[CAST(floor(0.5 * len(s)) AS INT) + 1] AS p50, s[CAST(floor(0.99 * len(s)) AS INT) + 1] AS p99,
       successes / total AS success_rate, hits / total AS hit_rate
FROM (SELECT KEYS, count(*) AS total, count(*) FILTER (WHERE {PASS}) AS successes, count(*) FILTER (WHERE cache_hit) AS hits,
        count(*) FILTER (WHERE status = 'failed') AS failures, count(*) FILTER (WHERE status = 'success' AND attempts > 1) AS retried,
        list_sort(list(duration_ms) FILTER (WHERE status = 'success' AND cache_hit IS NOT true)) AS s
      FROM runs WHERE status <> 'skipped' GROUP BY KEYS)"""


@query("A1_task_stats", STATS_SQL.replace("KEYS", "project, task"))
def a1(t):
    return S.task_stats(t.runs, "project", "task")


@query("A2_stats_by_definition", STATS_SQL.replace("KEYS", "project, task, def"))
def a2(t):
    return S.task_stats(t.runs, "project", "task", "def")


@query("A3_percentiles", "SELECT project, s[CAST(floor(0.5 * len(s)) AS INT) + 1] AS p50, s[CAST(floor(0.9 * len(s)) AS INT) + 1] AS p90 FROM (SELECT project, list_sort(list(duration_ms)) AS s FROM runs GROUP BY project)")
def a3(t):
    return S.percentiles(t.runs, "duration_ms", {"p50": 0.5, "p90": 0.9}, "project")


@query("A4_collected", "SELECT project, task, array_to_string(list_sort(list(duration_ms) FILTER (WHERE status = 'failed')), ',') AS failed_ms FROM runs GROUP BY ALL HAVING count(*) FILTER (WHERE status = 'failed') > 0")
def a4(t):
    g = t.runs.groupBy("project", "task").agg(F.sort_array(F.collect_list(F.when(F.col("status") == "failed", F.col("duration_ms")))).alias("l")).where(F.size("l") > 0)
    return g.select("project", "task", F.array_join(F.transform("l", lambda x: x.cast("string")), ",").alias("failed_ms"))


@query(
    "A5_max_of_two_sources",
    """SELECT r.project, r.task, max(CASE WHEN r.status = 'success' THEN r.peak_rss WHEN r.cache_hit THEN e.size_bytes END) AS peak
       FROM runs r LEFT JOIN entries e ON r.cache_hit AND e.project = r.project AND e.task = r.task AND e.hash = r.hash GROUP BY ALL""",
)
def a5(t):
    e = t.entries.select("project", "task", "hash", "size_bytes")
    j = t.runs.join(e, ["project", "task", "hash"], "left")
    own = F.when(F.col("status") == "success", F.col("peak_rss")).when(F.col("cache_hit"), F.col("size_bytes"))
    return j.groupBy("project", "task").agg(F.max(own).alias("peak"))


#: Cores that a run needs, and what a task's hits were produced with.
NEED = "CASE WHEN cpu_ms IS NOT NULL THEN least(cpu_ms / nullif(duration_ms * coalesce(cpu_share, 1), 0), coalesce(cores, cpu_ms / nullif(duration_ms * coalesce(cpu_share, 1), 0))) END"
PRODUCED = """
h AS (SELECT project, task, max(e.peak_rss) AS hit_rss, max(e.cpu_ms / CASE WHEN e.size_bytes > 0 THEN e.size_bytes END) AS hit_cpu
      FROM (SELECT DISTINCT project, task, hash FROM runs WHERE cache_hit) JOIN entries e USING (project, task, hash) GROUP BY ALL)"""
SATURATED = f"""
z AS (SELECT project, task, max(CASE WHEN fill >= LEAST THEN cores END) AS saturated_cores, max(m) AS saturated_memory FROM (
        SELECT project, task, cores, avg({NEED} / cores) AS fill, max(CASE WHEN peak_rss >= LEAST * placement_memory THEN placement_memory END) AS m
        FROM runs WHERE cores IS NOT NULL AND duration_ms > 0 AND status IN ('success', 'failed') AND cache_hit IS NOT true GROUP BY ALL) GROUP BY ALL)"""


@query(
    "A6_mean_need",
    f"""WITH {PRODUCED}, o AS (SELECT project, task, avg({NEED}) AS own FROM runs WHERE status = 'success' AND cache_hit IS NOT true AND cpu_ms IS NOT NULL AND duration_ms > 0 GROUP BY ALL)
        SELECT project, task, round(coalesce(own, hit_cpu), 9) AS need FROM (SELECT DISTINCT project, task FROM runs WHERE status <> 'skipped') LEFT JOIN o USING (project, task) LEFT JOIN h USING (project, task)""",
)
def a6(t):
    return S.mean_need(t.runs, t.entries).select("project", "task", F.round("need", 9).alias("need"))


@query("A7_saturation", f"WITH {SATURATED.replace('LEAST', '0.6::DOUBLE')} SELECT project, task, saturated_cores AS cores, saturated_memory AS memory FROM z WHERE saturated_cores IS NOT NULL OR saturated_memory IS NOT NULL")
def a7(t):
    return S.saturated(t.runs, 0.6)


@query("A8_row_of_max", "SELECT project, task, arg_max(hash, id) AS hash, max(id) AS id FROM runs WHERE hash <> '' GROUP BY ALL")
def a8(t):
    return t.runs.where(P.keyed()).groupBy("project", "task").agg(F.max_by("hash", "id").alias("hash"), F.max("id").alias("id"))


@query(
    "A9_cache_stats",
    f"""SELECT (SELECT count(*) FROM entries) AS entries, (SELECT sum(size_bytes)::BIGINT FROM entries) AS bytes,
          count(*) FILTER (WHERE status <> 'skipped') AS runs, count(*) FILTER (WHERE {HIT}) AS hits, coalesce(sum(duration_ms) FILTER (WHERE {HIT}), 0)::BIGINT AS restored_ms
        FROM runs WHERE started_at > {NOW} - 86400000 AND started_at <= {NOW}""",
)
def a9(t):
    return S.cache_stats(t.entries, t.runs, NOW)


OUTCOMES = f"""
k AS (SELECT *, coalesce({PASS} OR cache_hit, false) AS passed, min(CASE WHEN {PASS} OR cache_hit THEN id END) OVER (PARTITION BY project, task, hash) AS first_pass
      FROM runs WHERE hash <> '' AND cached IS NOT false AND blocked_by IS NULL),
o AS (SELECT project, task, hash, count(*) FILTER (WHERE status = 'failed') AS failures, count(*) FILTER (WHERE passed) AS passes,
        coalesce(sum(CASE WHEN status = 'success' AND attempts > 1 THEN attempts - 1 END), 0)::BIGINT AS retried, count(*) FILTER (WHERE status = 'failed' AND id > first_pass) AS relapses
      FROM k GROUP BY project, task, hash)"""


@query("A10_key_outcomes", f"WITH {OUTCOMES} SELECT * FROM o")
def a10(t):
    return S.key_outcomes(t.runs)


@query("A11_mixed_keys", f"WITH {OUTCOMES} SELECT project, task, count(*) AS mixed FROM o WHERE relapses > 0 GROUP BY ALL")
def a11(t):
    return S.mixed_keys(t.runs)


FLAKY = f"""WITH {OUTCOMES}
SELECT project, task, count(*) AS keys, sum(failures + retried)::BIGINT AS failures, sum(passes)::BIGINT AS passes, sum(retried)::BIGINT AS retried, count(*) FILTER (WHERE relapses > 0) AS mixed
FROM o WHERE relapses > 0 OR retried > 0 GROUP BY ALL"""


@query("A12_flaky_tasks", FLAKY)
def a12(t):
    return S.flaky_tasks(t.runs)


@query(
    "A13_failure_mode",
    f"""WITH {OUTCOMES}, m AS (SELECT project, task, count(*) AS mixed FROM o WHERE relapses > 0 GROUP BY ALL),
        s AS (SELECT project, task, count(*) AS total, count(*) FILTER (WHERE status = 'failed') AS failures, count(*) FILTER (WHERE status = 'success' AND attempts > 1) AS retried
              FROM runs WHERE status <> 'skipped' GROUP BY ALL)
        SELECT s.*, coalesce(mixed, 0) AS mixed, CASE WHEN retried = 0 AND (failures = 0 OR coalesce(mixed, 0) = 0) THEN 'stable'
               WHEN failures < total / 5 THEN 'flaky-recoverable' ELSE 'flaky-fatal' END AS mode
        FROM s LEFT JOIN m USING (project, task)""",
)
def a13(t):
    return S.failure_modes(t.runs)


@query("A14_single_timings", "SELECT project, hash AS task, min(id) AS id FROM runs WHERE status = 'success' AND id % 7 <> 0 GROUP BY ALL HAVING count(*) = 1 AND min(id) >= 100")
def a14(t):
    # a task for each key, so that many have one timing only
    timings = t.runs.where("status = 'success' AND id % 7 <> 0").select("id", "project", F.col("hash").alias("task"), "duration_ms")
    return S.single_timings(timings, 100)


#: Hits by what became of their outputs.
RESTORED = f"""count(*) FILTER (WHERE {HIT} AND restored IS NOT true) AS up_to_date, count(*) FILTER (WHERE status = 'cache-hit' AND restored) AS restored_local,
          count(*) FILTER (WHERE status = 'cache-hit-remote' AND restored) AS restored_remote"""


@query(
    "A15_run_headers",
    f"""SELECT run_id, count(*) AS tasks, count(*) FILTER (WHERE status = 'failed') AS failed, count(*) FILTER (WHERE {HIT}) AS hits,
          count(*) FILTER (WHERE status = 'cache-hit') AS hits_local, count(*) FILTER (WHERE status = 'cache-hit-remote') AS hits_remote,
          {RESTORED} FROM runs GROUP BY run_id""",
)
def a15(t):
    return S.run_headers(t.runs)


OUTCOME_ROWS = "SELECT * REPLACE (CASE WHEN id % 53 = 0 THEN 'aborted' ELSE status END AS status) FROM runs"


@query(
    "A16_tally",
    f"""SELECT run_id, count(*) FILTER (WHERE status <> 'aborted') AS total, count(*) FILTER (WHERE {PASS}) AS successful, count(*) FILTER (WHERE status = 'failed') AS failed,
          count(*) FILTER (WHERE status = 'skipped') AS skipped, count(*) FILTER (WHERE status = 'cache-hit') AS cached_local, count(*) FILTER (WHERE status = 'cache-hit-remote') AS cached_remote,
          count(*) FILTER (WHERE status = 'aborted') AS aborted, {RESTORED} FROM ({OUTCOME_ROWS}) GROUP BY run_id""",
)
def a16(t):
    return S.tally(t.runs.withColumn("status", F.when(F.expr("id % 53 = 0"), "aborted").otherwise(F.col("status"))))


@query(
    "A17_cache_buckets",
    """SELECT bucket, count(*) AS n FROM (SELECT CASE
         WHEN status IN ('success', 'failed') AND cached IS false AND (status = 'success' OR hash <> '') THEN 'noCache'
         WHEN status = 'success' THEN CASE saved WHEN true THEN 'saved' WHEN false THEN 'notSaved' ELSE 'miss' END WHEN status = 'failed' AND hash <> '' THEN 'miss'
         WHEN status LIKE 'cache-hit%' AND restored IS false THEN 'upToDate' WHEN status = 'cache-hit' THEN 'restoredLocal' WHEN status = 'cache-hit-remote' THEN 'restoredRemote' END AS bucket FROM runs)
       WHERE bucket IS NOT NULL GROUP BY bucket""",
)
def a17(t):
    return S.cache_buckets(t.runs)


@query("A18_duration_spread", f"SELECT project, max(duration_ms) AS longest, min(duration_ms) AS shortest, sum(duration_ms)::BIGINT AS total_ms, count(*) AS n FROM runs WHERE status <> 'skipped' AND NOT {HIT} GROUP BY project")
def a18(t):
    return S.duration_spread(t.runs, "project")


@query(
    "A19_time_saved",
    f"""SELECT r.project, sum(coalesce(e.size_bytes, 0))::BIGINT AS saved_ms FROM runs r LEFT JOIN entries e ON e.project = r.project AND e.task = r.task AND e.hash = r.hash
        WHERE {HIT.replace('status', 'r.status')} AND r.hash <> '' GROUP BY r.project""",
)
def a19(t):
    return S.time_saved(t.runs, t.entries)


@query("A20_blocked_by", "SELECT run_id, blocked_by, string_agg(DISTINCT project || '#' || task, ',' ORDER BY project || '#' || task) AS tasks FROM runs WHERE blocked_by IS NOT NULL GROUP BY ALL")
def a20(t):
    return S.blocked_by(t.runs)


@query("A21_distinct_tasks", "SELECT DISTINCT project, task FROM runs")
def a21(t):
    return t.runs.select("project", "task").distinct()


@query("A22_join_spread", "SELECT run_id, (max(started_at) - min(started_at)) / nullif(count(*) - 1, 0) AS spread FROM runs GROUP BY run_id")
def a22(t):
    return S.join_spread(t.runs)


@query("A23_reservations", "SELECT project, task, CASE WHEN max(peak_rss) >= 67108864 THEN CAST(ceil(max(peak_rss) * 1.25 / 67108864) * 67108864 AS BIGINT) END AS reserved FROM runs WHERE status <> 'skipped' GROUP BY ALL")
def a23(t):
    return S.reservations(t.runs)


@query(
    "A27_cpu_snapshot_diff",
    """WITH RECURSIVE sub AS (SELECT 5 AS node UNION SELECT e.src FROM sub JOIN edges e ON e.dst = sub.node)
       SELECT tag AS name, sum(node % 97 - cost)::BIGINT AS cpu FROM nodes WHERE node NOT IN (SELECT node FROM sub) GROUP BY tag ORDER BY cpu DESC, name LIMIT 3""",
)
def a27(t):
    # two tables of processes (node its id, tag its name), less the subtree of process 5 in the later one
    before, after = t.nodes.select("node", "tag", F.col("cost").alias("cpu")), t.nodes.select("node", "tag", F.expr("node % 97").alias("cpu"))
    return S.cpu_between(before, after, t.edges, t.nodes.where("node = 5").select("node"), 3).select(F.col("tag").alias("name"), "cpu")


@query("A28_worker_totals", "SELECT worker, count(*) AS tasks, sum(cores)::BIGINT AS booked, sum(stop - start)::BIGINT AS busy FROM spans GROUP BY worker HAVING sum(cores) > 0")
def a28(t):
    return t.spans.groupBy("worker").agg(F.count("*").alias("tasks"), F.sum("cores").alias("booked"), F.sum(F.col("stop") - F.col("start")).alias("busy")).where("booked > 0")


@query(
    "A29_doctor",
    f"""WITH f AS ({FLAKY})
        SELECT 'projects' AS fact, count(DISTINCT project) AS value FROM runs UNION ALL SELECT 'tasks', count(DISTINCT project || task) FROM runs
        UNION ALL SELECT 'entries', count(*) FROM entries UNION ALL SELECT 'bytes', sum(size_bytes)::BIGINT FROM entries
        UNION ALL SELECT 'orphans', (SELECT count(*) FROM entries e WHERE NOT EXISTS (SELECT 1 FROM runs r WHERE r.status = 'success' AND r.project = e.project AND r.task = e.task AND r.hash = e.hash)) UNION ALL SELECT 'hits_24h', count(*) FROM runs WHERE started_at > {NOW} - 86400000 AND {HIT} UNION ALL SELECT 'flaky', count(*) FROM f""",
)
def a29(t):
    return S.doctor(t.runs, t.entries, NOW)


@query(
    "F8_flaky_candidates",
    f"""WITH cut AS (SELECT max(id) * 3 // 4 AS c FROM runs), {OUTCOMES.replace("FROM runs WHERE", "FROM runs, cut WHERE id <= c AND")},
        n AS (SELECT r.* FROM runs r, cut WHERE id > c AND hash <> '' AND cached IS NOT false AND blocked_by IS NULL AND status IN ('success', 'failed'))
        SELECT n.id, n.project, n.task, n.hash, n.status, coalesce(passes, 0) + (n.status = 'success')::BIGINT AS passes, coalesce(failures, 0) + (n.status = 'failed')::BIGINT AS failures
        FROM n LEFT JOIN o USING (project, task, hash)
        WHERE CASE WHEN n.status = 'failed' THEN coalesce(passes, 0) > 0 ELSE coalesce(relapses, 0) > 0 OR coalesce(n.attempts, 1) > 1 END""",
)
def f8(t):
    # the last quarter of the rows is the run in progress
    cut = t.runs.agg(F.expr("max(id) * 3 div 4").alias("cut"))
    rows = t.runs.join(F.broadcast(cut))
    now = rows.where(P.observes_key() & F.col("status").isin("success", "failed") & (F.col("id") > F.col("cut")))
    return S.flaky_candidates(rows.where("id <= cut").drop("cut"), now.drop("cut"))


@query(
    "F9_known_flaky",
    f"""WITH {OUTCOMES}, f AS (SELECT DISTINCT project, task FROM o WHERE relapses > 0 OR retried > 0)
        SELECT a.project, a.task, a.hash, coalesce(o.passes > 0, false) OR f.task IS NOT NULL AS flaky FROM (SELECT DISTINCT project, task, hash FROM runs WHERE status = 'failed') a
        LEFT JOIN o ON o.project = a.project AND o.task = a.task AND o.hash = a.hash LEFT JOIN f ON f.project = a.project AND f.task = a.task""",
)
def f9(t):
    return S.known_flaky(t.runs, t.runs.where("status = 'failed'").select("project", "task", "hash"))


@query("W1_first_pass", f"SELECT id, min(CASE WHEN {PASS} THEN id END) OVER (PARTITION BY project, task, hash) AS first_pass FROM runs")
def w1(t):
    # summed up before it is joined back: no window over all rows of a key
    key = ["project", "task", "hash"]
    first = t.runs.groupBy(*key).agg(F.min(F.when(P.passed(), F.col("id"))).alias("first_pass"))
    return t.runs.select("id", *key).join(first, key).select("id", "first_pass")


@query("T1_newest_first", "SELECT id, run_id FROM runs ORDER BY id DESC LIMIT 25")
def t1(t):
    return t.runs.orderBy(F.desc("id")).limit(25).select("id", "run_id")


@query("T3_ranked_status", "SELECT id, status, duration_ms FROM runs ORDER BY CASE status WHEN 'failed' THEN 0 WHEN 'skipped' THEN 1 WHEN 'success' THEN 2 ELSE 3 END, duration_ms DESC, id LIMIT 40")
def t3(t):
    rank = F.when(F.col("status") == "failed", 0).when(F.col("status") == "skipped", 1).when(F.col("status") == "success", 2).otherwise(3)
    return t.runs.orderBy(rank, F.desc("duration_ms"), "id").limit(40).select("id", "status", "duration_ms")


@query("T4_best_k", "SELECT run_id, id, duration_ms FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY duration_ms DESC, id) AS n FROM runs) WHERE n <= 4")
def t4(t):
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy("run_id").orderBy(F.desc("duration_ms"), "id"))
    return t.runs.withColumn("n", n).where("n <= 4").select("run_id", "id", "duration_ms")


@query("T6_nearest_name", "SELECT project, arg_min(c, (d, c)) AS nearest, min(d) AS distance FROM (SELECT DISTINCT project, c, levenshtein(project, c) AS d FROM runs, (SELECT unnest(['p1', 'p22', 'q7', 'task']) AS c)) GROUP BY project")
def t6(t):
    near = t.spark.createDataFrame([("p1",), ("p22",), ("q7",), ("task",)], "c string")
    d = t.runs.select("project").distinct().crossJoin(F.broadcast(near)).withColumn("d", F.levenshtein("project", "c"))
    return d.groupBy("project").agg(F.min_by("c", F.struct("d", "c")).alias("nearest"), F.min("d").cast("long").alias("distance"))


@query("U1_union_all", "SELECT id, project FROM runs WHERE project = 'p1' UNION ALL SELECT id, project FROM runs WHERE task = 't1'")
def u1(t):
    r = t.runs.select("id", "project", "task")
    return r.where("project = 'p1'").unionByName(r.where("task = 't1'")).select("id", "project")


@query("U2_union", "SELECT project, task FROM runs WHERE project = 'p1' UNION SELECT project, task FROM runs WHERE task = 't1'")
def u2(t):
    r = t.runs.select("project", "task")
    return r.where("project = 'p1'").union(r.where("task = 't1'")).distinct()


@query("U3_difference", "SELECT node FROM projects WHERE starts_with(name, '@s') EXCEPT SELECT node FROM projects WHERE node % 7 = 3")
def u3(t):
    from ..operators.selection import without

    return without(t.projects.where(P.glob("name", "@s*")).select("node"), t.projects.where("node % 7 = 3"))


@query("U4_intersection", "SELECT node FROM projects WHERE starts_with(name, '@s') INTERSECT SELECT node FROM projects WHERE node % 7 = 4")
def u4(t):
    return t.projects.where(P.glob("name", "@s*")).select("node").intersect(t.projects.where("node % 7 = 4").select("node"))


@query("U6_last_wins", "SELECT name FROM (SELECT project AS name, arg_max(status = 'failed', id) AS negated FROM runs GROUP BY 1) WHERE NOT negated")
def u6(t):
    from ..operators.selection import last_wins

    return last_wins(t.runs.select(F.col("id").alias("pos"), F.col("project").alias("name"), (F.col("status") == "failed").alias("negated")))


@query(
    "U7_declared_over_learned",
    """SELECT coalesce(a.project, b.project) AS project, coalesce(a.cores, b.cores) AS cores, coalesce(a.rss, b.rss) AS rss
       FROM (SELECT project, CASE WHEN project < 'p4' THEN 4 END::BIGINT AS cores, CASE WHEN project > 'p2' THEN 1 END::BIGINT AS rss FROM runs GROUP BY 1) a
       FULL JOIN (SELECT project, max(cores) AS cores, max(peak_rss) AS rss FROM runs GROUP BY 1) b ON a.project = b.project""",
)
def u7(t):
    a = t.runs.select("project").distinct().select("project", F.expr("IF(project < 'p4', 4L, NULL)").alias("c"), F.expr("IF(project > 'p2', 1L, NULL)").alias("r"))
    b = t.runs.groupBy("project").agg(F.max("cores").alias("cores"), F.max("peak_rss").alias("rss"))
    return a.join(b, "project", "full").select("project", F.coalesce("c", "cores").alias("cores"), F.coalesce("r", "rss").alias("rss"))


@query("Fs1_split_id", "SELECT DISTINCT project || '#' || task || '#x' AS id, project AS head, task || '#x' AS tail FROM runs")
def fs1(t):
    i = t.runs.select(F.concat_ws("#", "project", "task", F.lit("x")).alias("id")).distinct()
    return i.select("id", F.substring_index("id", "#", 1).alias("head"), F.expr("substring(id, instr(id, '#') + 1)").alias("tail"))


@query("Fs3_capped_distance", "SELECT DISTINCT project, least(levenshtein(project, 'p10'), 2)::BIGINT AS d FROM runs")
def fs3(t):
    return t.runs.select("project").distinct().select("project", F.least(F.levenshtein("project", F.lit("p10")), F.lit(2)).cast("long").alias("d"))


@query("Fs6_name_list", "SELECT run_id, array_to_string(l[1:3], ', ') || CASE WHEN len(l) > 3 THEN ' and ' || (len(l) - 3) || ' more' ELSE '' END AS names FROM (SELECT run_id, list_sort(list(DISTINCT project)) AS l FROM runs GROUP BY run_id)")
def fs6(t):
    g = t.runs.groupBy("run_id").agg(F.sort_array(F.collect_set("project")).alias("l"))
    more = F.when(F.size("l") > 3, F.concat(F.lit(" and "), (F.size("l") - 3).cast("string"), F.lit(" more"))).otherwise("")
    return g.select("run_id", F.concat(F.array_join(F.slice("l", 1, 3), ", "), more).alias("names"))


@query("Fs11_literals", "SELECT id, CASE WHEN id % 3 = 0 THEN cores * 1024 WHEN id % 3 = 1 THEN cores * 1073741824 ELSE cores END AS bytes, CASE id % 3 WHEN 0 THEN cores * 60000 WHEN 1 THEN cores END AS ms FROM runs")
def fs11(t):
    r = t.runs.select("id", F.expr("concat(cores, CASE id % 3 WHEN 0 THEN 'K' WHEN 1 THEN 'G' ELSE '' END)").alias("s"), F.expr("concat(cores, CASE id % 3 WHEN 0 THEN 'm' WHEN 1 THEN 'ms' ELSE 'M' END)").alias("d"))
    return r.select("id", M.parse_size(F.col("s")).alias("bytes"), M.parse_duration(F.col("d")).alias("ms"))


@query(
    "Fs15b_text_locations",
    r"""WITH w AS (SELECT doc_id, k, toks[k] AS tok FROM (SELECT doc_id, toks, unnest(range(1, len(toks) + 1)) AS k FROM (SELECT doc_id, regexp_extract_all(text, '[\w./@+\-]+(?::\d+(?::\d+)?|\(\d+,\d+\))?') AS toks FROM documents))),
         b AS (SELECT *, regexp_replace(tok, '(?::\d+(?::\d+)?|\(\d+,\d+\))$', '') AS body FROM w),
         n AS (SELECT doc_id, k, body, regexp_extract_all(substr(tok, length(body) + 1), '\d+') AS nums, regexp_extract(regexp_extract(body, '^/?[^/]+(?:/[^/]+)*'), '^((?:.*/)?[^./][^/]*\.[A-Za-z][A-Za-z0-9]{0,9})', 1) AS raw FROM b),
         f AS (SELECT doc_id, k, CASE WHEN raw = body THEN nums ELSE [] END AS nums, CASE WHEN raw[1] = '/' THEN '/' ELSE '' END || substr(list_reduce(list_prepend('', string_split(raw, '/')),
                 lambda acc, x: CASE WHEN x IN ('', '.') THEN acc WHEN x = '..' AND acc <> '' AND acc NOT LIKE '%/..' THEN regexp_replace(acc, '/[^/]*$', '') ELSE acc || '/' || x END), 2) AS path FROM n WHERE raw <> ''),
         d AS (SELECT doc_id, path, nums[1]::BIGINT AS line, nums[2]::BIGINT AS col, min(k) AS k FROM f GROUP BY ALL),
         u AS (SELECT *, bool_or(line IS NOT NULL) OVER (PARTITION BY doc_id, path) AS lined FROM d),
         o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS place FROM u WHERE line IS NOT NULL OR NOT lined)
       SELECT doc_id, place::INTEGER AS place, path, line, col FROM o""",
)
def fs15b(t):
    return t.table("documents").select("doc_id", F.posexplode(X.every_file_location(F.col("text")))).select("doc_id", F.col("pos").alias("place"), "col.*")


@query("Fs17_head_tail", "SELECT doc_id, CASE WHEN length(text) <= 300 THEN text ELSE left(text, 100) || right(text, 200) END AS shown FROM documents")
def fs17(t):
    x = F.col("text")
    return t.table("documents").select("doc_id", F.when(F.length(x) <= 300, x).otherwise(F.concat(F.left(x, F.lit(100)), F.right(x, F.lit(200)))).alias("shown"))


@query("Fs18_tail_cap", "SELECT doc_id, right(text, 500) AS kept, greatest(length(text) - 500, 0) AS dropped FROM documents")
def fs18(t):
    return t.table("documents").select("doc_id", F.right("text", F.lit(500)).alias("kept"), F.greatest(F.length("text") - 500, F.lit(0)).cast("long").alias("dropped"))


@query("Fs19_ansi_strip", "SELECT id, project || '-' || task AS clean FROM runs")
def fs19(t):
    raw = F.concat(F.lit("\x1b[31m"), "project", F.lit("\x1b[0m-"), "task")
    return t.runs.select("id", F.regexp_replace(raw, "\x1b\\[[0-9;]*[A-Za-z]", "").alias("clean"))


@query("Fm2_alone_time", "SELECT id, CASE WHEN duration_ms > 0 THEN round(duration_ms - (cpu_ms / 0.5 - cpu_ms) / greatest(1.0, cpu_ms / (duration_ms * 0.5)), 6) ELSE duration_ms END AS alone FROM runs")
def fm2(t):
    return t.runs.select("id", F.round(M.alone_time(F.col("duration_ms"), F.col("cpu_ms"), F.lit(0.5)), 6).alias("alone"))


@query("Fm4_booked_cores", "SELECT id, greatest(1.0::DOUBLE, round(cpu_ms / 1000.0::DOUBLE * 4) / 4) AS booked FROM runs")
def fm4(t):
    return t.runs.select("id", M.booked_cores(F.col("cpu_ms") / F.lit(1000.0)).alias("booked"))


@query("Fd1_by_day", "SELECT strftime(make_timestamp(started_at * 1000), '%Y-%m-%d') AS day, count(DISTINCT project) AS projects, count(*) AS n FROM runs GROUP BY 1")
def fd1(t):
    day = F.date_format(F.expr("timestampadd(MILLISECOND, started_at, TIMESTAMP_NTZ'1970-01-01 00:00:00')"), "yyyy-MM-dd")
    return t.runs.groupBy(day.alias("day")).agg(F.countDistinct("project").alias("projects"), F.count("*").alias("n"))


@query("Fj1_json_path", "SELECT event_id, CAST(props ->> '$.k' AS INTEGER) AS k FROM events")
def fj1(t):
    return t.table("events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"))


ASKED = """SELECT r.project || '#' || r.task AS id, count(*) AS n, count(DISTINCT r.hash) AS keys, count(DISTINCT i.cache_policy) AS policies, count(CASE WHEN i.exit_ok THEN 1 END) AS good
    FROM runs r JOIN invocations i ON i.run_id = r.run_id GROUP BY 1"""


@query("Q1_read_only_sql", ASKED)
def q1(t):
    return ask({name: getattr(t, name) for name in RELATIONS}, ASKED + "; -- one statement", json=True)
