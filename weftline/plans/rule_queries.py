"""Stable keys, charges of shared servers, retention and worker measures."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import attribution as AT
from ..operators import history as H
from ..operators import stability as ST
from .registry import query

USERS = ("t0", "t1", "t2", "t3")
_SUM = "base + c0 * u0 + c1 * u1 + c2 * u2 + c3 * u3"


@query(
    "F12_server_charges",
    f"""WITH RECURSIVE l AS MATERIALIZED (
          SELECT project AS server, id, row_number() OVER (PARTITION BY project ORDER BY id) AS n, id % 97 / 16::DOUBLE AS cores, duration_ms::DOUBLE AS ms, id % 6 = 0 AS capped,
                 {', '.join(f'(id >> {i}) & 1 AS u{i}' for i in range(4))} FROM runs),
        f AS (SELECT DISTINCT server, NULL::BIGINT AS id, 0::BIGINT AS n, 0::DOUBLE AS cores, 0::DOUBLE AS ms, {', '.join(f'0::BIGINT AS u{i}' for i in range(4))}, 0::DOUBLE AS base, {', '.join(f'0::DOUBLE AS c{i}' for i in range(4))} FROM l
              UNION ALL
              SELECT server, id, n, cores, ms, u0, u1, u2, u3, CASE WHEN held OR k > 0 THEN base ELSE greatest(0, base + 0.3::DOUBLE * error) END,
                     {', '.join(f'CASE WHEN held OR u{i} = 0 THEN c{i} ELSE greatest(0, c{i} + 0.3::DOUBLE * error / k) END' for i in range(4))}
              FROM (SELECT *, capped AND error < 0 AS held FROM (
                     SELECT *, cores - ({_SUM}) AS error, u0 + u1 + u2 + u3 AS k FROM (
                      SELECT l.*, f.base, f.c0, f.c1, f.c2, f.c3 FROM f JOIN l ON l.server = f.server AND l.n = f.n + 1))))
       {' UNION ALL '.join(f"SELECT server, id, base, '{u}' AS task, c{i} AS cost, CASE WHEN cores > 0 AND ms > 0 AND {_SUM} > 0 THEN cores * ms * c{i} / ({_SUM}) ELSE 0 END AS charged FROM f WHERE n > 0 AND u{i} = 1" for i, u in enumerate(USERS))}
       UNION ALL SELECT server, id, base, NULL, NULL, NULL FROM f WHERE n > 0 AND u0 + u1 + u2 + u3 = 0""",
)
def f12(t):
    users = F.expr(f"filter(array({', '.join(repr(u) for u in USERS)}), (u, i) -> (shiftright(id, i) & 1) = 1)")
    return AT.charges(t.runs.select(F.col("project").alias("server"), "id", users.alias("users"), F.expr("id % 97 / 16D").alias("cores"), F.col("duration_ms").alias("ms"), F.expr("id % 6 = 0").alias("capped")))


@query("F10b_daily_sweep", "SELECT id, project, task FROM task_durations WHERE started_at >= (SELECT max(started_at) FROM task_durations) - 10 * 86400000::BIGINT")
def f10b(t):
    now = t.task_durations.agg(F.max("started_at").alias("now"), (F.max("started_at") - 86_400_000).alias("swept"))
    return H.swept(t.task_durations, now, days=10, at="started_at").select("id", "project", "task")


@query(
    "F11b_worker_measures",
    """SELECT cores, CASE WHEN k.known IS NULL THEN w.warm ELSE least(w.warm, 2 * k.known) END AS warm_ms, floor(w.pace * 1000 + 0.5)::BIGINT AS pace
       FROM (SELECT cores, min(duration_ms)::DOUBLE AS warm, sum(cpu_ms) / nullif(sum(duration_ms), 0)::DOUBLE AS pace FROM runs WHERE status = 'success' GROUP BY cores) w
       LEFT JOIN (SELECT cores, min(duration_ms)::DOUBLE AS known FROM runs WHERE status = 'failed' AND cores <> 3 GROUP BY cores) k USING (cores)""",
)
def f11b(t):
    now = t.runs.where("status = 'success'").groupBy("cores").agg(F.min("duration_ms").cast("double").alias("warm"), F.expr("try_divide(sum(cpu_ms), CAST(sum(duration_ms) AS DOUBLE))").alias("pace"))
    known = t.runs.where("status = 'failed' AND cores <> 3").groupBy("cores").agg(F.min("duration_ms").cast("double").alias("known"))
    return H.worker_measures(now, known, "cores")


TASKS = """SELECT node AS task, 'q' || (node % 13) AS project, 'packages/q' || (node % 13) AS dir, node % 5 <> 0 AS cached,
                  CASE WHEN node % 11 = 0 THEN NULL WHEN node % 7 = 0 THEN ['**/*.ts'] WHEN node % 7 < 3 THEN ['src/**', 'gen/x.ts'] WHEN node % 7 < 5 THEN ['dist/**', '!dist/a/**'] ELSE ['src/**', 'package.json'] END AS inputs,
                  CASE WHEN node % 17 = 0 THEN ['packages/q' || (node % 11) || '/dist/**'] WHEN node % 17 = 1 THEN ['lock.json'] ELSE [] END AS ws_inputs,
                  CASE WHEN node % 3 = 0 AND node % 13 <> 4 THEN ['dist/a/**'] WHEN node % 31 = 1 AND node % 13 <> 4 THEN ['gen/**'] ELSE [] END AS outputs,
                  CASE WHEN node % 97 = 50 THEN ['gen/**'] ELSE [] END AS ws_outputs,
                  CASE WHEN node % 29 = 20 THEN 'project' WHEN node % 211 = 60 THEN 'workspace' ELSE 'none' END AS reach FROM nodes"""
_LITERAL = r"CASE WHEN NOT regexp_matches(G, '[*?{\[]') THEN G ELSE rtrim(regexp_extract(G, '^([^*?{\[]*/)', 1), '/') END"
_MEET = "(A = '' OR B = '' OR A = B OR starts_with(A, B || '/') OR starts_with(B, A || '/'))"


def _meet(a: str, b: str) -> str:
    return _MEET.replace("A", "\1").replace("B", b).replace("\1", a)


def _literal(g: str) -> str:
    return _LITERAL.replace("G", g)


@query(
    "G24_stable_keys",
    f"""WITH RECURSIVE t AS MATERIALIZED ({TASKS}), c AS (SELECT src AS task, dst AS up FROM edges UNION SELECT c.task, e.dst FROM c JOIN edges e ON e.src = c.up),
        d AS MATERIALIZED (SELECT DISTINCT c.task, u.project, u.reach = 'project' AS wide FROM c JOIN t u ON u.task = c.up WHERE len(u.outputs) > 0 OR u.reach = 'project'),
        o AS MATERIALIZED (SELECT project, dir, task AS writer, g, {_literal('g')} AS w FROM (SELECT project, dir, task, unnest(outputs) AS g FROM t)),
        i AS (SELECT task, project, inputs, {_literal('g')} AS r FROM (SELECT task, project, inputs, unnest(inputs) AS g FROM t) WHERE NOT starts_with(g, '!')),
        mine AS (SELECT d.* FROM d JOIN t USING (task, project) WHERE t.inputs IS NOT NULL),
        same AS (SELECT task FROM mine WHERE wide OR project NOT IN (SELECT project FROM o)
                 UNION SELECT i.task FROM i JOIN mine USING (task, project) JOIN (SELECT DISTINCT project, g, w FROM o) o ON o.project = i.project AND {_meet('i.r', 'o.w')} WHERE NOT (list_contains(i.inputs, '!dist/a/**') AND o.g = 'dist/a/**')
                 UNION SELECT a.writer FROM o a JOIN mine ON mine.task = a.writer AND mine.project = a.project JOIN o b ON b.project = a.project AND b.writer <> a.writer AND {_meet('a.w', 'b.w')}),
        anywhere AS (SELECT t.task FROM t WHERE inputs IS NOT NULL AND task IN (SELECT c.task FROM c JOIN t u ON u.task = c.up WHERE len(u.ws_outputs) > 0 OR u.reach = 'workspace')),
        heads AS (SELECT DISTINCT d.task, CASE WHEN x.whole THEN 'packages/' || d.project ELSE o.dir || '/' || o.w END AS w
                  FROM (SELECT task, project, any_wide OR project NOT IN (SELECT project FROM o) AS whole FROM (SELECT task, project, bool_or(wide) AS any_wide FROM d GROUP BY task, project)) x JOIN (SELECT DISTINCT task, project FROM d) d USING (task, project) LEFT JOIN o ON o.project = d.project),
        met AS (SELECT x.task FROM (SELECT task, {_literal('g')} AS r FROM (SELECT task, unnest(ws_inputs) AS g FROM t WHERE inputs IS NOT NULL)) x JOIN heads h ON h.task = x.task AND {_meet('x.r', 'h.w')}),
        own AS (SELECT task, min(k) AS k FROM (SELECT task, 0 AS k FROM same UNION ALL SELECT task, 1 FROM anywhere UNION ALL SELECT task, 2 FROM met) GROUP BY task),
        late AS (SELECT DISTINCT c.task FROM c JOIN own ON own.task = c.up)
       SELECT t.task, cached AND because IS NULL AS stable, because FROM t
       JOIN (SELECT t.task, CASE own.k WHEN 0 THEN 'same-project' WHEN 1 THEN 'workspace-output' WHEN 2 THEN 'workspace-input' ELSE CASE WHEN late.task IS NOT NULL THEN 'upstream' END END AS because
             FROM t LEFT JOIN own USING (task) LEFT JOIN late ON late.task = t.task) b USING (task)""",
)
def g24(t):
    globs = lambda *g: F.array(*(F.lit(x) for x in g))
    n7, none = F.expr("node % 7"), F.array().cast("array<string>")
    project = F.concat(F.lit("q"), F.expr("node % 13"))
    tasks = t.nodes.select(
        F.col("node").alias("task"), project.alias("project"), F.concat(F.lit("packages/"), project).alias("dir"), F.expr("node % 5 <> 0").alias("cached"),
        F.when(F.expr("node % 11 = 0"), None).when(n7 == 0, globs("**/*.ts")).when(n7 < 3, globs("src/**", "gen/x.ts")).when(n7 < 5, globs("dist/**", "!dist/a/**")).otherwise(globs("src/**", "package.json")).alias("inputs"),
        F.when(F.expr("node % 17 = 0"), F.array(F.concat(F.lit("packages/q"), F.expr("node % 11"), F.lit("/dist/**")))).when(F.expr("node % 17 = 1"), globs("lock.json")).otherwise(none).alias("ws_inputs"),
        F.when(F.expr("node % 3 = 0 AND node % 13 <> 4"), globs("dist/a/**")).when(F.expr("node % 31 = 1 AND node % 13 <> 4"), globs("gen/**")).otherwise(none).alias("outputs"),
        F.when(F.expr("node % 97 = 50"), globs("gen/**")).otherwise(none).alias("ws_outputs"),
        F.when(F.expr("node % 29 = 20"), "project").when(F.expr("node % 211 = 60"), "workspace").otherwise("none").alias("reach"),
    )
    return ST.classified(tasks, t.edges)
