"""As-of lookups, intervals, sweep lines, running totals, forecasts and folds."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import forecast as FC
from ..operators import timeline as TL
from .history_queries import NEED, PRODUCED, SATURATED
from .registry import query

PASS = "status IN ('success', 'cache-hit', 'cache-hit-remote')"


@query("J1_dictionary_join", "SELECT r.id, i.exit_ok FROM runs r LEFT JOIN invocations i ON r.run_id = i.run_id")
def j1(t):
    return t.runs.select("id", "run_id").join(t.invocations.select("run_id", "exit_ok"), "run_id", "left").select("id", "exit_ok")


@query("J2_literal_in_on", "SELECT r.id, e.size_bytes FROM runs r LEFT JOIN entries e ON r.cache_hit AND e.project = r.project AND e.task = r.task AND e.hash = r.hash")
def j2(t):
    r, e = t.runs.alias("r"), t.entries.alias("e")
    on = F.col("r.cache_hit") & (F.col("e.project") == F.col("r.project")) & (F.col("e.task") == F.col("r.task")) & (F.col("e.hash") == F.col("r.hash"))
    return r.join(e, on, "left").select("r.id", "e.size_bytes")


@query("J3_producers", "SELECT e.entry, e.size_bytes FROM entries e JOIN (SELECT DISTINCT project, task, hash FROM runs WHERE cache_hit AND hash <> '') h USING (project, task, hash)")
def j3(t):
    h = t.runs.where("cache_hit AND hash <> ''").select("project", "task", "hash").distinct()
    return t.entries.join(h, ["project", "task", "hash"]).select("entry", "size_bytes")


@query("J4_newest_timings", "SELECT project, task, id, place FROM (SELECT *, row_number() OVER (PARTITION BY project, task ORDER BY id DESC) AS place FROM task_durations) WHERE place <= 5")
def j4(t):
    return TL.newest_per_task(t.task_durations, 5, "project", "task").select("project", "task", "id", "place")


@query("J5_latest_row", "SELECT project, task, arg_max(duration_ms, id) AS duration_ms, arg_max(source, id) AS source FROM task_durations GROUP BY ALL")
def j5(t):
    g = t.task_durations.groupBy("project", "task").agg(F.max_by(F.struct("duration_ms", "source"), "id").alias("r"))
    return g.select("project", "task", "r.duration_ms", "r.source")


@query("J7_previous_keyed", "SELECT id, project, task, hash, lag(id) OVER w AS prev_id, lag(hash) OVER w AS prev_hash FROM runs WHERE hash <> '' WINDOW w AS (PARTITION BY project, task ORDER BY id)")
def j7(t):
    return TL.previous_keyed(t.runs)


@query(
    "J8_fixed_in",
    f"""SELECT * FROM (SELECT id, project, task, run_id, status, first(CASE WHEN {PASS} THEN run_id END IGNORE NULLS) OVER
          (PARTITION BY project, task ORDER BY id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS fixed_in FROM runs) WHERE status = 'failed'""",
)
def j8(t):
    return TL.fixed_in(t.runs)


@query(
    "J9_running_at",
    """SELECT point_id, place, project, task, start FROM (SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY start, project, task) AS place FROM (
         SELECT p.id AS point_id, s.project, s.task, min(s.start) AS start
         FROM (SELECT id, started_at AS at FROM runs) p JOIN spans s ON p.at >= s.start - 5 AND p.at <= s.stop + 5 GROUP BY ALL)) WHERE place <= 3""",
)
def j9(t):
    points = t.runs.select(F.col("id").alias("point_id"), F.col("started_at").alias("at"))
    return TL.running_at(points, t.spans)


@query("J10_anti", "SELECT DISTINCT hash FROM runs WHERE hash <> '' AND NOT EXISTS (SELECT 1 FROM runs b WHERE b.hash = runs.hash AND b.status = 'failed' AND b.project = 'p1')")
def j10(t):
    bad = t.runs.where("status = 'failed' AND project = 'p1'").select("hash")
    return t.runs.where("hash <> ''").select("hash").distinct().join(bad, "hash", "left_anti")


@query("J11_semi", "SELECT id FROM runs WHERE run_id IN (SELECT run_id FROM invocations WHERE NOT exit_ok)")
def j11(t):
    return t.runs.join(t.invocations.where("NOT exit_ok").select("run_id"), "run_id", "left_semi").select("id")


@query("J12_row_value_semi", "SELECT id FROM runs WHERE (project, task) IN (('p1', 't1'), ('p2', 't2'))")
def j12(t):
    asked = t.spark.createDataFrame([("p1", "t1"), ("p2", "t2")], "project string, task string")
    return t.runs.join(F.broadcast(asked), ["project", "task"], "left_semi").select("id")


@query(
    "J13_priority_lookup",
    """SELECT hash, source, duration_ms FROM (SELECT r.hash, d.source, d.duration_ms, row_number() OVER (PARTITION BY r.hash
         ORDER BY CASE d.source WHEN 'branch:1' THEN 0 WHEN 'branch:0' THEN 1 ELSE 2 END, d.id DESC) AS n
       FROM task_durations d JOIN runs r ON r.id = d.id WHERE d.source IN ('branch:1', 'branch:0', 'remote') AND r.hash <> '') WHERE n = 1""",
)
def j13(t):
    order = t.spark.createDataFrame([("branch:1", 0), ("branch:0", 1), ("remote", 2)], "source string, place int")
    d = t.task_durations.join(F.broadcast(order), "source").join(t.runs.where("hash <> ''").select("id", "hash"), "id")
    best = d.groupBy("hash").agg(F.min_by(F.struct("source", "duration_ms"), F.struct("place", -F.col("id"))).alias("r"))
    return best.select("hash", "r.source", "r.duration_ms")


@query("J14_pair_update", "SELECT entry, CASE WHEN project = 'p1' AND task = 't1' THEN 0 ELSE size_bytes END AS size_bytes FROM entries")
def j14(t):
    asked = t.spark.createDataFrame([('[["p1","t1"]]',)], "j string").select(F.explode(F.from_json("j", "array<array<string>>")).alias("k"))
    asked = asked.select(F.col("k")[0].alias("project"), F.col("k")[1].alias("task"), F.lit(True).alias("asked"))
    return t.entries.join(F.broadcast(asked), ["project", "task"], "left").select("entry", F.when(F.col("asked"), F.lit(0)).otherwise(F.col("size_bytes")).alias("size_bytes"))


@query(
    "J20_failed_of_last_run",
    f"""WITH x AS (SELECT *, first(CASE WHEN {PASS} THEN run_id END IGNORE NULLS) OVER (PARTITION BY project, task ORDER BY id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS fixed_in FROM runs)
        SELECT id, project, task, fixed_in FROM x WHERE status = 'failed' AND run_id = (SELECT max(run_id) FROM invocations WHERE NOT exit_ok)""",
)
def j20(t):
    last = t.invocations.where("NOT exit_ok").agg(F.max("run_id").alias("run_id"))
    return TL.fixed_in(t.runs).join(F.broadcast(last), "run_id").select("id", "project", "task", "fixed_in")


@query(
    "J21_log_source",
    """SELECT r.id, CASE WHEN r.status = 'failed' THEN 'note' WHEN r.id = e.last_id THEN 'entry' WHEN r.cache_hit AND e.last_id IS NOT NULL AND e.accessed_at >= r.started_at THEN 'entry' ELSE 'none' END AS source
       FROM runs r LEFT JOIN entries e USING (project, task, hash)""",
)
def j21(t):
    j = t.runs.join(t.entries.select("project", "task", "hash", "last_id", "accessed_at"), ["project", "task", "hash"], "left")
    source = F.when(F.col("status") == "failed", "note").when(F.col("id") == F.col("last_id"), "entry").when(F.col("cache_hit") & (F.col("accessed_at") >= F.col("started_at")), "entry").otherwise("none")
    return j.select("id", source.alias("source"))


@query("W2_newest_k", "SELECT source, id FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY id DESC) AS n FROM task_durations) WHERE n <= 5")
def w2(t):
    return TL.newest_per_task(t.task_durations, 5, "source").select("source", "id")


@query(
    "W3_evicted",
    """SELECT entry, accessed_at, size_bytes FROM (SELECT *, coalesce(sum(size_bytes) OVER (ORDER BY accessed_at, entry ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS earlier,
         sum(size_bytes) OVER () AS total FROM entries) WHERE total - earlier > 1000000""",
)
def w3(t):
    return TL.evicted(t.entries, 1_000_000)


@query("W5_dense_rank", "SELECT DISTINCT project, run_id, n FROM (SELECT project, run_id, dense_rank() OVER (PARTITION BY project ORDER BY run_id DESC) AS n FROM runs) WHERE n <= 50")
def w5(t):
    from pyspark.sql import Window

    # the run ids of a project are ranked once each, not its rows
    ids = t.runs.select("project", "run_id").distinct()
    n = F.row_number().over(Window.partitionBy("project").orderBy(F.desc("run_id")))
    return ids.withColumn("n", n.cast("long")).where("n <= 50")


SWEEP = """
e AS (SELECT worker, moment, delta, sum(n) AS n, sum(c) AS c, sum(m) AS m FROM (
        SELECT worker, start AS moment, 1 AS delta, 1 AS n, cores AS c, memory AS m FROM spans UNION ALL SELECT worker, stop, -1, -1, -cores, -memory FROM spans) GROUP BY ALL),
r AS (SELECT worker, sum(n) OVER w AS open, sum(c) OVER w AS cores, sum(m) OVER w AS memory, lead(moment) OVER (PARTITION BY worker ORDER BY moment, delta) - moment AS dt
      FROM e WINDOW w AS (PARTITION BY worker ORDER BY moment, delta ROWS UNBOUNDED PRECEDING)),
g AS (SELECT worker, max(open)::BIGINT AS peak_open, max(cores)::BIGINT AS peak_cores, max(memory)::BIGINT AS peak_memory, coalesce(sum(dt) FILTER (WHERE open > 0), 0)::BIGINT AS busy_ms,
        coalesce(sum(cores * dt), 0)::BIGINT AS core_ms FROM r GROUP BY worker)"""


@query("A24_concurrency", f"WITH {SWEEP} SELECT * FROM g")
def a24(t):
    return TL.concurrency(t.spans, "worker")


@query(
    "A25_utilization",
    f"""WITH {SWEEP} SELECT worker, online_ms, least(1.0::DOUBLE, core_ms / nullif(online_ms * 8, 0)) AS utilization, core_ms / nullif(online_ms, 0) AS mean_cores
        FROM g JOIN (SELECT worker, max(stop) - min(start) AS online_ms FROM spans GROUP BY worker) USING (worker)""",
)
def a25(t):
    return TL.utilization(t.spans, 8, "worker")


@query("A26_step_integral", "SELECT project, coalesce(sum(cores * dt), 0)::BIGINT AS integral FROM (SELECT project, cores, lead(id) OVER (PARTITION BY project ORDER BY id) - id AS dt FROM runs) GROUP BY project")
def a26(t):
    return TL.step_integral(t.runs.select("project", F.col("id").alias("at"), F.col("cores").alias("value")), "project")


@query("W6_running_delta", f"WITH {SWEEP} SELECT worker, open::BIGINT AS open, count(*) AS n FROM r GROUP BY ALL")
def w6(t):
    # ends come before starts of the same moment
    e = TL._events(t.spans, "worker").withColumn("order", F.col("at") * 2 + F.expr("IF(delta > 0, 1, 0)"))
    e = TL.running_in_cells(e, "order", ["worker"], {"was": F.col("n")}, {}, 7_200_000)
    return e.groupBy("worker", (F.col("was") + F.col("n")).alias("open")).agg(F.count("*").alias("n"))


@query(
    "F3_tiered_forecast",
    """WITH d AS (SELECT *, row_number() OVER (PARTITION BY project, task ORDER BY id DESC) AS n FROM task_durations),
        o AS (SELECT *, row_number() OVER (PARTITION BY project, task ORDER BY id DESC) AS n FROM task_durations WHERE source = 'branch:1'),
        r AS (SELECT *, row_number() OVER (PARTITION BY project, task ORDER BY id DESC) AS n FROM task_durations WHERE source = 'remote'),
        da AS (SELECT project, task, list_sort(list(duration_ms)) AS s FROM d WHERE n <= 5 GROUP BY ALL),
        oa AS (SELECT project, task, list_sort(list(duration_ms)) AS s FROM o WHERE n <= 5 GROUP BY ALL),
        ra AS (SELECT project, task, list_sort(list(duration_ms)) AS s FROM r WHERE n <= 1 GROUP BY ALL)
        SELECT da.project, da.task, coalesce(oa.s[len(oa.s) // 2 + 1], ra.s[1], da.s[len(da.s) // 2 + 1]) AS expected_ms,
          coalesce(oa.s[len(oa.s)], ra.s[1], da.s[len(da.s)]) AS slow_ms, CASE WHEN oa.s IS NOT NULL THEN 'branch' WHEN ra.s IS NOT NULL THEN 'remote' ELSE 'any' END AS tier
        FROM da LEFT JOIN oa USING (project, task) LEFT JOIN ra USING (project, task)""",
)
def f3(t):
    return FC.tiered(t.task_durations, "branch:1")


@query("F4_slow_duration", "SELECT project, task, max(duration_ms) AS slow FROM (SELECT *, row_number() OVER (PARTITION BY project, task ORDER BY id DESC) AS n FROM task_durations) WHERE n <= 5 GROUP BY ALL")
def f4(t):
    return TL.newest_per_task(t.task_durations, 5, "project", "task").groupBy("project", "task").agg(F.max("duration_ms").alias("slow"))


#: The server's fold of a report (d, c, r, t) into a timing, as SQL.
MOVED = """(abs(d - duration_ms) > duration_ms * 0.05::DOUBLE OR (c IS NOT NULL AND (cores IS NULL OR abs(c - cores) > cores * 0.05::DOUBLE))
      OR (r IS NOT NULL AND (rss IS NULL OR r > rss)) OR t - updated_at >= 86400000)"""
FOLD = {
    "duration_ms": "trunc(duration_ms * 0.7::DOUBLE + d * 0.3::DOUBLE + 0.5::DOUBLE)::BIGINT", "cores": "coalesce(cores * 0.7::DOUBLE + c * 0.3::DOUBLE, c, cores)",
    "rss": "CASE WHEN r IS NULL THEN rss WHEN rss IS NULL THEN r ELSE greatest(r, trunc(rss * 0.9::DOUBLE)::BIGINT) END", "slow_ms": "greatest(d, trunc(slow_ms * 0.9::DOUBLE)::BIGINT)", "runs": "runs + 1", "updated_at": "t",
}
REPORTS = "SELECT project, task, id, duration_ms AS d, CASE WHEN id % 3 <> 0 THEN cores::DOUBLE END AS c, CASE WHEN id % 4 <> 0 THEN peak_rss END AS r, started_at AS t FROM task_durations"


def _reports(t):
    return t.task_durations.select("project", "task", "id", "duration_ms", F.expr("IF(id % 3 <> 0, double(cores), NULL)").alias("cores"), F.expr("IF(id % 4 <> 0, peak_rss, NULL)").alias("rss"), F.col("started_at").alias("at"))


@query(
    "F1_ewma_fold",
    f"""WITH RECURSIVE s AS (SELECT *, row_number() OVER (PARTITION BY project, task ORDER BY id) AS n FROM ({REPORTS})),
        f AS (SELECT project, task, n, d AS duration_ms, c AS cores, r AS rss, d AS slow_ms, 1::BIGINT AS runs, t AS updated_at FROM s WHERE n = 1
              UNION ALL
              SELECT f.project, f.task, s.n, {', '.join(f'CASE WHEN {MOVED} THEN {x} ELSE {k} END' for k, x in FOLD.items())}
              FROM f JOIN s ON f.project = s.project AND f.task = s.task AND s.n = f.n + 1)
        SELECT project, task, duration_ms, round(cores, 6) AS cores, rss, slow_ms, runs, updated_at FROM (SELECT *, max(n) OVER (PARTITION BY project, task) AS last FROM f) WHERE n = last""",
)
def f1(t):
    return FC.server_fold(_reports(t), "project", "task").withColumn("cores", F.round("cores", 6))


@query("F2_flaky_flip", f"SELECT project, task, hash, CASE WHEN min(id) FILTER (WHERE status = 'failed') < max(id) FILTER (WHERE {PASS}) THEN 'flaky' ELSE 'fail' END AS outcome FROM runs WHERE hash <> '' GROUP BY ALL HAVING count(*) FILTER (WHERE status = 'failed') > 0")
def f2(t):
    failed, ok = F.min(F.when(F.col("status") == "failed", F.col("id"))), F.max(F.when(F.expr(PASS), F.col("id")))
    g = t.runs.where("hash <> ''").groupBy("project", "task", "hash").agg(failed.alias("f"), ok.alias("p")).where("f IS NOT NULL")
    return g.select("project", "task", "hash", F.when(F.col("f") < F.col("p"), "flaky").otherwise("fail").alias("outcome"))


@query(
    "F5_measures",
    """SELECT project, task, s[len(s) // 2 + 1] AS cores, max_d AS slow FROM (SELECT project, task, list_sort(list(cores)) AS s, max(duration_ms) AS max_d FROM
         (SELECT *, row_number() OVER (PARTITION BY project, task ORDER BY id DESC) AS n FROM task_durations) WHERE n <= 5 GROUP BY ALL)""",
)
def f5(t):
    from ..functions.measures import nearest_rank

    top = TL.newest_per_task(t.task_durations, 5, "project", "task")
    return top.groupBy("project", "task").agg(nearest_rank(F.col("cores"), 0.5).alias("cores"), F.max("duration_ms").alias("slow"))


@query(
    "F5b_tiered_measures",
    """WITH cur AS (SELECT project, task, arg_max(def, id) AS now FROM runs WHERE def IS NOT NULL GROUP BY ALL), imp AS (SELECT project, task, max(duration_ms) AS known FROM remote_hits JOIN runs USING (id) GROUP BY ALL),
        d AS (SELECT t.*, r.def FROM task_durations t JOIN runs r ON r.id = t.id), k AS (SELECT d.* FROM d LEFT JOIN cur c ON c.project = d.project AND c.task = d.task WHERE d.def IS NULL OR now IS NULL OR d.def = now),
        u AS (SELECT 0 AS tier, * FROM k WHERE source = 'branch:1' AND project <> 'p3' UNION ALL SELECT 1, * FROM k WHERE source = 'remote' UNION ALL SELECT 2, * FROM k WHERE source LIKE 'branch:%' AND NOT (project = 'p3' AND source = 'branch:1')),
        n AS (SELECT *, row_number() OVER (PARTITION BY project, task, tier ORDER BY id DESC) AS n FROM u),
        g AS (SELECT project, task, tier, list_sort(list(duration_ms)) AS ds, list_sort(list(cpu_parallelism) FILTER (WHERE cpu_parallelism IS NOT NULL)) AS cs, max(duration_ms) AS slow FROM n WHERE n <= CASE tier WHEN 1 THEN 1 ELSE 5 END GROUP BY ALL),
        f AS (SELECT *, row_number() OVER (PARTITION BY project, task ORDER BY tier) AS k FROM g)
       SELECT f.project, f.task, CASE tier WHEN 0 THEN 'own' WHEN 1 THEN 'remote' ELSE 'any' END AS tier, ds[len(ds) // 2 + 1] AS duration_ms, cs[len(cs) // 2 + 1] AS cores, CASE WHEN tier = 1 THEN coalesce(known, slow) ELSE slow END AS slow_ms
       FROM f LEFT JOIN imp ON imp.project = f.project AND imp.task = f.task WHERE f.k = 1""",
)
def f5b(t):
    # one project has no rows on the branch, so that its tasks come from a tier below
    d = t.task_durations.where("NOT (project = 'p3' AND source = 'branch:1')").join(t.runs.select("id", "def"), "id").withColumn("cores", F.col("cpu_parallelism"))
    current = t.runs.where("def IS NOT NULL").groupBy("project", "task").agg(F.max_by("def", "id").alias("def"))
    imported = t.remote_hits.select("id").join(t.runs, "id").groupBy("project", "task").agg(F.max("duration_ms").alias("slow_ms"))
    return FC.tiered_measures(d, "branch:1", current, imported)


@query(
    "F6_resources",
    f"""WITH {PRODUCED}, {SATURATED.replace('LEAST', '0.9::DOUBLE')},
        o AS (SELECT project, task, max(peak_rss) AS own_rss, avg(CASE WHEN duration_ms > 0 AND cpu_ms IS NOT NULL THEN {NEED} END) AS own FROM runs WHERE status = 'success' AND cache_hit IS NOT true GROUP BY ALL),
        i AS (SELECT project, task, arg_max(cpu_parallelism, id) AS imported FROM task_durations WHERE source = 'remote' AND cpu_parallelism IS NOT NULL GROUP BY ALL)
        SELECT project, task, round(coalesce(own, imported, hit_cpu), 9) AS need, CASE WHEN own IS NOT NULL THEN 'own' WHEN imported IS NOT NULL THEN 'imported' WHEN hit_cpu IS NOT NULL THEN 'hit' END AS need_from,
          greatest(own_rss, hit_rss) AS peak_rss, saturated_cores, saturated_memory
        FROM (SELECT DISTINCT project, task FROM runs) LEFT JOIN o USING (project, task) LEFT JOIN i USING (project, task) LEFT JOIN h USING (project, task) LEFT JOIN z USING (project, task)""",
)
def f6(t):
    return FC.resources(t.runs, t.entries, t.task_durations).withColumn("need", F.round("need", 9))


@query(
    "F7_first_hits",
    """SELECT project, task, hash, h AS id FROM (SELECT project, task, hash, min(id) FILTER (WHERE cache_hit) AS h, min(id) FILTER (WHERE status = 'success') AS p FROM runs WHERE hash <> '' GROUP BY ALL)
       WHERE h IS NOT NULL AND (p IS NULL OR h < p)""",
)
def f7(t):
    return FC.first_hits(t.runs)


@query(
    "F13_running_usage",
    """SELECT project AS key, id, max(cpu_ms) OVER w AS cpu, max(peak_rss) OVER w AS peak, max(cpu_ms) OVER w / nullif(started_at - min(started_at) OVER w, 0) AS mean_cores
       FROM runs WINDOW w AS (PARTITION BY project ORDER BY started_at, id ROWS UNBOUNDED PRECEDING)""",
)
def f13(t):
    return FC.running_usage(t.runs.select(F.col("project").alias("key"), "id", F.col("started_at").alias("at"), "cpu_ms", F.col("peak_rss").alias("rss")))


@query("R8_settled_changes", "SELECT key, id, state FROM (SELECT project AS key, id, status AS state, lag(status) OVER (PARTITION BY project ORDER BY id) AS p, row_number() OVER (PARTITION BY project ORDER BY id) AS n FROM runs) WHERE n = 1 OR p IS DISTINCT FROM state")
def r8(t):
    return TL.settled_changes(t.runs.select(F.col("project").alias("key"), "id", F.col("status").alias("state")))


@query("R2_outcomes", "SELECT run_id, project, task, arg_max(status, id) AS status FROM runs GROUP BY ALL")
def r2(t):
    return t.runs.groupBy("run_id", "project", "task").agg(F.max_by("status", "id").alias("status"))


@query("R5_sampled_gauges", "SELECT id, project, cpu_ms - coalesce(lag(cpu_ms) OVER (PARTITION BY project ORDER BY id), 0) AS cpu_delta, peak_rss FROM runs")
def r5(t):
    near = TL.neighbour(t.runs.select("id", "project", "cpu_ms", "peak_rss"), F.struct("cpu_ms"), "project")
    return near.select("id", "project", (F.col("cpu_ms") - F.coalesce("_near.cpu_ms", F.lit(0))).alias("cpu_delta"), "peak_rss")


@query("R9_log_budget", "SELECT id FROM (SELECT id, sum(duration_ms) OVER (PARTITION BY run_id ORDER BY status = 'failed' DESC, id DESC ROWS UNBOUNDED PRECEDING) AS used FROM runs) WHERE used <= 200000")
def r9(t):
    from pyspark.sql import Window

    w = Window.partitionBy("run_id").orderBy(F.desc(F.col("status") == "failed"), F.desc("id")).rowsBetween(Window.unboundedPreceding, 0)
    return t.runs.withColumn("used", F.sum("duration_ms").over(w)).where("used <= 200000").select("id")
