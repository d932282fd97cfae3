"""The relations of a run history, derived from the test tables by arithmetic.

Each relation is defined twice: as a DataFrame, and as the SQL that states the
same rule for an independent engine.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Tables:
    """Relations by name over one folder of tables; each is a plan, nothing is read before use."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def runs(self) -> DataFrame:
        e = self.table("events")
        k = F.get_json_object("props", "$.k")
        status = (
            F.when(F.expr("event_id % 31 = 0"), "skipped").when(F.expr("event_type = 'error'"), "failed")
            .when(F.expr("event_type = 'view'"), "cache-hit").when(F.expr("event_type = 'signup'"), "cache-hit-remote").otherwise("success")
        )
        start = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts) div 1000")
        r = e.select(
            F.col("event_id").alias("id"), F.concat(F.lit("p"), F.expr("user_id % 15")).alias("project"), F.concat(F.lit("t"), F.expr("user_id % 4")).alias("task"),
            F.when(F.expr("event_id % 41 = 0"), "").otherwise(k).alias("hash"), status.alias("status"), F.floor(F.col("value") * 1000).cast("long").alias("duration_ms"),
            start.cast("long").alias("started_at"), F.date_format("ts", "yyyyMMddHH").alias("run_id"), "user_id",
        )
        return r.select(
            "id", "project", "task", "hash", "status", "duration_ms",
            F.when(F.expr("id % 17 = 0 AND status IN ('success', 'failed')"), F.expr("1 + id div 17 % 4")).cast("long").alias("attempts"),
            F.when(F.expr("id % 23 <> 0"), F.lit(True)).when(F.expr("id % 46 = 0"), F.lit(False)).alias("cached"),
            F.when(F.expr("id % 37 <> 0"), F.col("status").isin("cache-hit", "cache-hit-remote")).alias("cache_hit"),
            "started_at", (F.col("started_at") + F.col("duration_ms")).alias("ended_at"), "run_id",
            F.expr("duration_ms * (id % 7 + 1) div 4").alias("cpu_ms"), F.expr("(id % 97) * 1048576").alias("peak_rss"), F.expr("id % 8 + 1").alias("cores"),
            F.expr("CASE id % 5 WHEN 0 THEN 0.5D WHEN 1 THEN 0.25D END").alias("cpu_share"), F.expr("(id % 8 + 1) * 12582912").alias("placement_memory"),
            F.when(F.expr("status IN ('cache-hit', 'cache-hit-remote') AND id % 19 <> 0"), F.expr("id % 3 <> 0")).alias("restored"),
            F.when(F.expr("status = 'success' AND id % 29 <> 0"), F.expr("id % 4 <> 0")).alias("saved"),
            F.when(F.expr("status = 'skipped'"), F.concat(F.lit("t"), F.expr("(user_id + 1) % 4"))).alias("blocked_by"),
            F.when(F.expr("id % 13 <> 0"), F.concat(F.lit("d"), F.expr("user_id % 2"))).alias("def"),
        )

    @cached_property
    def invocations(self) -> DataFrame:
        failed = F.sum(F.expr("CASE WHEN status = 'failed' THEN 1 ELSE 0 END")).cast("long")
        g = self.runs.groupBy("run_id").agg(F.min("started_at").alias("started_at"), F.max("ended_at").alias("ended_at"), F.count("*").alias("task_count"), failed.alias("failed_count"))
        hour = F.substring("run_id", 9, 2).cast("int")
        policy = F.when(hour % 3 == 0, "local:rw,remote:rw").when(hour % 3 == 1, "local:r,remote:r").otherwise("local:rw,remote:")
        return g.withColumns({"exit_ok": F.col("failed_count") == 0, "cache_policy": policy})

    @cached_property
    def entries(self) -> DataFrame:
        passed = self.runs.where("status IN ('success', 'cache-hit', 'cache-hit-remote') AND hash <> ''")
        g = passed.groupBy("project", "task", "hash").agg(F.max_by(F.struct("duration_ms", "started_at", "cpu_ms", "peak_rss"), "id").alias("r"), F.max("id").alias("last_id"))
        return g.select(F.concat_ws("#", "project", "task", "hash").alias("entry"), "project", "task", "hash", F.col("r.duration_ms").alias("size_bytes"), F.col("r.started_at").alias("accessed_at"), "last_id", "r.cpu_ms", "r.peak_rss")

    @cached_property
    def entry_inputs(self) -> DataFrame:
        li = self.table("lineitem")
        g = li.groupBy(F.col("l_orderkey").alias("entry"), F.col("l_returnflag").alias("kind"), F.col("l_partkey").cast("string").alias("name"))
        return g.agg(F.max("l_suppkey").cast("string").alias("hash"))

    @cached_property
    def task_durations(self) -> DataFrame:
        r = self.runs.where("status = 'success'")
        n = F.expr("id % 3").cast("string")
        return r.select("id", "project", "task", "duration_ms", F.when(F.expr("id % 29 = 0"), "remote").otherwise(F.concat(F.lit("branch:"), n)).alias("source"), "cores", "peak_rss", "started_at", F.expr("IF(id % 2 = 0, try_divide(cpu_ms, duration_ms), NULL)").alias("cpu_parallelism"))

    @cached_property
    def nodes(self) -> DataFrame:
        return self.table("part").select(F.col("p_partkey").alias("node"), F.col("p_name").alias("name"), F.col("p_brand").alias("tag"), F.col("p_size").cast("long").alias("cost"))

    @cached_property
    def edges(self) -> DataFrame:
        p = self.table("part").where("p_partkey >= 1")
        e = p.select(F.col("p_partkey").alias("src"), F.explode(F.array(F.expr("p_partkey div 2"), F.expr("p_partkey div 3"))).alias("dst"))
        return e.where("src <> dst").distinct()

    @cached_property
    def projects(self) -> DataFrame:
        p = self.table("part")
        dir_ = F.concat_ws("/", F.lit("packages"), F.expr("concat('b', p_partkey % 7)"), F.expr("concat('p', p_partkey)"))
        name = F.when(F.expr("p_partkey % 2 = 0"), F.expr("concat('@s', p_partkey % 5, '/lib-', p_partkey)")).otherwise(F.expr("concat('lib-', p_partkey)"))
        return p.select(F.col("p_partkey").alias("node"), name.alias("name"), dir_.alias("dir"), F.array(F.col("p_brand"), F.split("p_type", " ")[0]).alias("tags"))

    @cached_property
    def spans(self) -> DataFrame:
        return self.runs.where("status <> 'skipped'").select("id", "project", "task", F.expr("id % 10").alias("worker"), F.col("started_at").alias("start"), F.col("ended_at").alias("stop"), "cores", F.col("peak_rss").alias("memory"))


    @cached_property
    def steps(self) -> DataFrame:
        g = self.runs.groupBy("run_id", F.col("project").alias("step")).agg(F.sum("duration_ms").alias("duration_ms"), F.min("started_at").alias("started_at"), F.min("id").alias("seq"))
        return g.withColumn("ok", F.expr("seq % 11 <> 0"))

    @cached_property
    def warnings(self) -> DataFrame:
        return self.runs.where("duration_ms > 90000").select("run_id", F.col("id").alias("seq"), F.concat_ws(" ", F.lit("slow:"), "task").alias("text"), "started_at")

    @cached_property
    def failures(self) -> DataFrame:
        return self.runs.where("status = 'failed'").select("run_id", F.col("id").alias("seq"), "project", "task", F.expr("1 + id % 3").alias("exit_code"), "started_at")

    @cached_property
    def task_outcomes(self) -> DataFrame:
        r = self.runs.where("hash <> '' AND status IN ('success', 'failed')")
        return r.select("id", "project", "task", F.col("hash").alias("key"), F.when(F.col("status") == "failed", "fail").otherwise("pass").alias("outcome"), "started_at")

    @cached_property
    def remote_hits(self) -> DataFrame:
        return self.runs.where("status = 'cache-hit-remote'").select("id", "hash", "started_at")


#: The relations that are named to whoever asks in SQL.
RELATIONS = ("runs", "invocations", "steps", "warnings", "failures", "entries", "entry_inputs", "task_durations", "task_outcomes")

#: The same rules as SQL; a relation may use those before it.
SQL = {
    "runs": """
        SELECT id, project, task, hash, status, duration_ms,
               CASE WHEN id % 17 = 0 AND status IN ('success', 'failed') THEN 1 + id // 17 % 4 END::BIGINT AS attempts,
               CASE WHEN id % 23 <> 0 THEN true WHEN id % 46 = 0 THEN false END AS cached,
               CASE WHEN id % 37 <> 0 THEN status IN ('cache-hit', 'cache-hit-remote') END AS cache_hit,
               started_at, started_at + duration_ms AS ended_at, run_id,
               duration_ms * (id % 7 + 1) // 4 AS cpu_ms, (id % 97) * 1048576 AS peak_rss, id % 8 + 1 AS cores,
               CASE id % 5 WHEN 0 THEN 0.5::DOUBLE WHEN 1 THEN 0.25::DOUBLE END AS cpu_share, (id % 8 + 1) * 12582912 AS placement_memory,
               CASE WHEN status IN ('cache-hit', 'cache-hit-remote') AND id % 19 <> 0 THEN id % 3 <> 0 END AS restored,
               CASE WHEN status = 'success' AND id % 29 <> 0 THEN id % 4 <> 0 END AS saved,
               CASE WHEN status = 'skipped' THEN 't' || ((user_id + 1) % 4) END AS blocked_by,
               CASE WHEN id % 13 <> 0 THEN 'd' || (user_id % 2) END AS def
        FROM (SELECT event_id AS id, user_id, 'p' || (user_id % 15) AS project, 't' || (user_id % 4) AS task,
                     CASE WHEN event_id % 41 = 0 THEN '' ELSE props ->> '$.k' END AS hash,
                     CASE WHEN event_id % 31 = 0 THEN 'skipped' WHEN event_type = 'error' THEN 'failed' WHEN event_type = 'view' THEN 'cache-hit'
                          WHEN event_type = 'signup' THEN 'cache-hit-remote' ELSE 'success' END AS status,
                     CAST(floor(value * 1000) AS BIGINT) AS duration_ms, epoch_us(ts) // 1000 AS started_at, strftime(ts, '%Y%m%d%H') AS run_id
              FROM events)""",
    "invocations": """
        SELECT *, failed_count = 0 AS exit_ok,
               CASE substr(run_id, 9, 2)::INT % 3 WHEN 0 THEN 'local:rw,remote:rw' WHEN 1 THEN 'local:r,remote:r' ELSE 'local:rw,remote:' END AS cache_policy
        FROM (SELECT run_id, min(started_at) AS started_at, max(ended_at) AS ended_at, count(*) AS task_count,
                     count(*) FILTER (WHERE status = 'failed') AS failed_count FROM runs GROUP BY run_id)""",
    "entries": """
        SELECT project || '#' || task || '#' || hash AS entry, project, task, hash, arg_max(duration_ms, id) AS size_bytes,
               arg_max(started_at, id) AS accessed_at, max(id) AS last_id, arg_max(cpu_ms, id) AS cpu_ms, arg_max(peak_rss, id) AS peak_rss
        FROM runs WHERE status IN ('success', 'cache-hit', 'cache-hit-remote') AND hash <> '' GROUP BY project, task, hash""",
    "entry_inputs": """
        SELECT l_orderkey AS entry, l_returnflag AS kind, l_partkey::VARCHAR AS name, max(l_suppkey)::VARCHAR AS hash
        FROM lineitem GROUP BY ALL""",
    "task_durations": """
        SELECT id, project, task, duration_ms, CASE WHEN id % 29 = 0 THEN 'remote' ELSE 'branch:' || (id % 3) END AS source, cores, peak_rss, started_at,
               CASE WHEN id % 2 = 0 THEN cpu_ms / nullif(duration_ms, 0) END AS cpu_parallelism
        FROM runs WHERE status = 'success'""",
    "steps": "SELECT *, seq % 11 <> 0 AS ok FROM (SELECT run_id, project AS step, sum(duration_ms)::BIGINT AS duration_ms, min(started_at) AS started_at, min(id) AS seq FROM runs GROUP BY run_id, project)",
    "warnings": "SELECT run_id, id AS seq, 'slow: ' || task AS text, started_at FROM runs WHERE duration_ms > 90000",
    "failures": "SELECT run_id, id AS seq, project, task, 1 + id % 3 AS exit_code, started_at FROM runs WHERE status = 'failed'",
    "task_outcomes": "SELECT id, project, task, hash AS key, CASE WHEN status = 'failed' THEN 'fail' ELSE 'pass' END AS outcome, started_at FROM runs WHERE hash <> '' AND status IN ('success', 'failed')",
    "remote_hits": "SELECT id, hash, started_at FROM runs WHERE status = 'cache-hit-remote'",
    "nodes": "SELECT p_partkey AS node, p_name AS name, p_brand AS tag, p_size::BIGINT AS cost FROM part",
    "edges": """
        SELECT DISTINCT src, dst FROM (SELECT p_partkey AS src, p_partkey // 2 AS dst FROM part WHERE p_partkey >= 1
                                       UNION ALL SELECT p_partkey, p_partkey // 3 FROM part WHERE p_partkey >= 1) WHERE src <> dst""",
    "projects": """
        SELECT p_partkey AS node, CASE WHEN p_partkey % 2 = 0 THEN '@s' || (p_partkey % 5) || '/lib-' || p_partkey ELSE 'lib-' || p_partkey END AS name,
               'packages/b' || (p_partkey % 7) || '/p' || p_partkey AS dir, [p_brand, split_part(p_type, ' ', 1)] AS tags FROM part""",
    "spans": """
        SELECT id, project, task, id % 10 AS worker, started_at AS start, ended_at AS stop, cores, peak_rss AS memory FROM runs WHERE status <> 'skipped'""",
}


def with_relations(body: str) -> str:
    """The query with the relations that it names, directly or through others, before it."""
    import re

    needed: set[str] = set()

    def need(text: str) -> None:
        for name in SQL:
            if name not in needed and re.search(rf"\b(FROM|JOIN)\s+{name}\b", text):
                needed.add(name)
                need(SQL[name])

    need(body)
    ctes = [f"{name} AS ({SQL[name]})" for name in SQL if name in needed]
    own = re.match(r"\s*WITH\s+(RECURSIVE\s+)?", body)
    if not ctes:
        return body
    if own:
        return f"WITH {own[1] or ''}{', '.join(ctes)}, {body[own.end():]}"
    return f"WITH {', '.join(ctes)} {body}"
