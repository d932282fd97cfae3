"""Text rules, small scalars, precedence lookups, contracted graphs and counters."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import measures as M
from ..functions import predicates as P
from ..functions import text as X
from ..operators import forecast as FC
from ..operators import graph as G
from ..operators import selection as SEL
from ..operators import timeline as TL
from ..operators import history as H
from ..sources.bindings import RELATIONS
from ..sources.shared import shuffled
from .registry import query
from .time_queries import FOLD, MOVED


@query("Fs2_concat_substr", "SELECT id, substr(run_id, 1, 8) || '-' || project AS label FROM runs")
def fs2(t):
    return t.runs.select("id", F.concat(F.substring("run_id", 1, 8), F.lit("-"), "project").alias("label"))


@query("Fs5_near_matches", "SELECT project, d, n FROM (SELECT project, levenshtein(project, 'p10')::BIGINT AS d, row_number() OVER (ORDER BY levenshtein(project, 'p10'), project) AS n FROM (SELECT DISTINCT project FROM runs)) WHERE n <= 3")
def fs5(t):
    d = t.runs.select("project").distinct().withColumn("d", F.levenshtein("project", F.lit("p10")).cast("long"))
    few = d.orderBy("d", "project").limit(3)
    return few.withColumn("n", F.row_number().over(Window.orderBy("d", "project")).cast("long"))


@query(
    "Fs5b_near_match_rules",
    """SELECT name, row_number() OVER (ORDER BY rank, name) AS place FROM (SELECT name, CASE WHEN levenshtein(name, 'p10') < 3 THEN levenshtein(name, 'p10')
         WHEN contains(lower(name), 'p10') OR regexp_matches('p10', '(^|[^a-z0-9])' || lower(name) || '($|[^a-z0-9])') THEN 3 END AS rank FROM (SELECT DISTINCT project AS name FROM runs)) WHERE rank IS NOT NULL AND name <> 'p10' ORDER BY rank, name LIMIT 3""",
)
def fs5b(t):
    return SEL.near_matches(t.runs.select("project"), "p10")


@query("Fs9_printable", r"SELECT id, project || '\x09' || task || '\x1b' AS shown FROM runs")
def fs9(t):
    return t.runs.select("id", X.printable(F.concat("project", F.lit("\t"), "task", F.lit("\x1b"))).alias("shown"))


@query("Fs10_markdown_cell", r"SELECT doc_id, CASE WHEN length(f) > 80 THEN left(f, 79) || '…' ELSE f END AS cell FROM (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text, '(^|[^\\])((?:\\\\)*)\|', '\1\2\\|', 'g'), '(^|[^\\])((?:\\\\)*)\|', '\1\2\\|', 'g'), '\r\n|\r|\n', ' ', 'g') AS f FROM documents)")
def fs10(t):
    return t.table("documents").select("doc_id", X.markdown_cell(F.col("text")).alias("cell"))


@query("Fs12_format_bytes", "SELECT id, CASE WHEN peak_rss >= 1048576 THEN format('{:.1f} MiB', peak_rss / 1048576) ELSE peak_rss || ' B' END AS shown FROM runs")
def fs12(t):
    return t.runs.select("id", M.format_bytes(F.col("peak_rss")).alias("shown"))


@query("Fs14_paths", "SELECT node, 'packages/b' || (node % 7) || '/' AS prefix, CASE WHEN node % 7 = 3 THEN '' ELSE '../b' || (node % 7) || '/' END || 'p' || node AS rel FROM projects")
def fs14(t):
    p = t.projects.select("node", "dir", F.concat(F.lit("packages/b"), F.expr("node % 7"), F.lit("/*/src/**")).alias("glob"))
    return p.select("node", X.static_prefix(F.col("glob")).alias("prefix"), X.relative(F.col("dir"), F.lit("packages/b3")).alias("rel"))


@query("Fm1_scalars", "SELECT id, round(duration_ms / 7.0::DOUBLE, 2) AS r, abs(duration_ms - 500) AS a, CASE WHEN attempts IS NOT NULL THEN least(attempts, cores) END AS l FROM runs")
def fm1(t):
    return t.runs.select("id", F.round(F.col("duration_ms") / F.lit(7.0), 2).alias("r"), F.abs(F.col("duration_ms") - 500).alias("a"), M.least_or_null(F.col("attempts"), F.col("cores")).alias("l"))


@query("Fm3_clamp", "SELECT id, least(greatest(duration_ms, 100), 5000) AS ms FROM runs")
def fm3(t):
    return t.runs.select("id", M.clamp(F.col("duration_ms"), 100, 5000).cast("long").alias("ms"))


@query("Fd2_rolling_cutoffs", "SELECT count(*) FILTER (WHERE started_at > 1705622400000) AS day, count(*) FILTER (WHERE started_at > 1704067200000) AS month FROM runs WHERE started_at <= 1705708800000")
def fd2(t):
    now, day = 1_705_708_800_000, 86_400_000
    n = lambda since: F.count(F.when(F.col("started_at") > since, 1))
    return t.runs.where(F.col("started_at") <= now).agg(n(now - day).alias("day"), n(1_704_067_200_000).alias("month"))


@query("Fa1_array_any_first", "SELECT run_id, list_contains(l, 'failed') AS any_failed, array_to_string(l[1:2], ',') AS first FROM (SELECT run_id, list(status ORDER BY id) AS l FROM runs GROUP BY run_id)")
def fa1(t):
    g = t.runs.groupBy("run_id").agg(F.sort_array(F.collect_list(F.struct("id", "status"))).alias("l")).select("run_id", F.col("l.status").alias("l"))
    return g.select("run_id", F.exists("l", lambda s: s == "failed").alias("any_failed"), F.array_join(F.slice("l", 1, 2), ",").alias("first"))


@query("J19_phantoms", "SELECT e.entry, e.size_bytes FROM entries e LEFT JOIN (SELECT DISTINCT project || '#' || task || '#' || hash AS entry FROM runs WHERE status = 'failed') f ON f.entry = e.entry WHERE f.entry IS NOT NULL")
def j19(t):
    f = t.runs.where("status = 'failed'").select(F.concat_ws("#", "project", "task", "hash").alias("entry"), F.lit(True).alias("f")).distinct()
    return t.entries.join(f, "entry", "left").where("f IS NOT NULL").select("entry", "size_bytes")


@query(
    "J22_precedence",
    """WITH v AS (SELECT *, [hash::INT // 10, hash::INT % 10] AS version FROM entries), names AS (SELECT DISTINCT project FROM entries),
            r AS (SELECT project, [k, 5] AS lo, [k + 2, 5] AS hi, 'range ' || k AS v FROM names, (SELECT unnest([1, 2, 6]) AS k) WHERE project <> 'p3')
       SELECT e.entry, coalesce(CASE WHEN e.last_id % 5 = 0 THEN 'exact' END, (SELECT min(r.v) FROM r WHERE r.project = e.project AND e.version >= r.lo AND e.version < r.hi), CASE WHEN e.project <> 'p4' THEN 'name ' || e.project END) AS v FROM v e""",
)
def j22(t):
    # versions have two numbers, so 10 comes after 2; every project but one has ranges, every one but another a default
    e = t.entries.select("entry", "project", "last_id", F.array(F.expr("CAST(hash AS INT) div 10"), F.expr("CAST(hash AS INT) % 10")).alias("version"))
    names = t.entries.select("project").distinct()
    exact = t.entries.where("last_id % 5 = 0").select("entry", F.lit("exact").alias("v"))
    ranges = names.where("project <> 'p3'").select("project", F.explode(F.array(*map(F.lit, (1, 2, 6)))).alias("k"))
    ranges = ranges.select("project", F.array(F.col("k"), F.lit(5)).alias("lo"), F.array(F.col("k") + 2, F.lit(5)).alias("hi"), F.concat_ws(" ", F.lit("range"), "k").alias("v"))
    return H.by_precedence(e, exact, ranges, names.where("project <> 'p4'").select("project", F.concat_ws(" ", F.lit("name"), "project").alias("v")))


@query("K3_conflict_ignored", "SELECT run_id, coalesce(min(id) FILTER (WHERE id % 3 = 0), max(id)) AS id FROM runs GROUP BY run_id")
def k3(t):
    # a run that has its row keeps it; a later import adds only the others
    first = t.runs.where("id % 3 = 0").groupBy("run_id").agg(F.min("id").alias("id"))
    again = t.runs.groupBy("run_id").agg(F.max("id").alias("id"))
    return first.unionByName(again.join(first.select("run_id"), "run_id", "left_anti"))


@query("R6_delta_counters", "SELECT run_id, n, n - coalesce(lag(n) OVER (PARTITION BY substr(run_id, 1, 8) ORDER BY run_id), 0) AS delta FROM (SELECT run_id, count(*) AS n FROM runs GROUP BY run_id)")
def r6(t):
    g = t.runs.groupBy("run_id").agg(F.count("*").alias("n")).withColumn("day", F.substring("run_id", 1, 8))
    return g.select("run_id", "n", (F.col("n") - F.coalesce(F.lag("n").over(Window.partitionBy("day").orderBy("run_id")), F.lit(0))).alias("delta"))


@query(
    "G4_tiered_dependents",
    """WITH RECURSIVE w AS (SELECT src AS origin, dst AS node FROM edges WHERE src % 3 <> 0 UNION SELECT w.origin, e.dst FROM w JOIN edges e ON e.src = w.node WHERE w.node % 3 = 0),
        h AS (SELECT DISTINCT origin AS src, node AS dst FROM w WHERE node % 3 <> 0),
        c AS (SELECT src AS origin, dst AS node FROM h UNION SELECT c.origin, h.dst FROM c JOIN h ON h.src = c.node)
       SELECT n.node, count(c.origin) AS dependents FROM nodes n LEFT JOIN c ON c.node = n.node WHERE n.node % 3 <> 0 GROUP BY n.node""",
)
def g4(t):
    commands = t.nodes.where("node % 3 <> 0")
    contracted = G.nearest_holders(t.edges, commands, commands).select(F.col("origin").alias("src"), F.col("node").alias("dst"))
    return G.dependent_counts(commands, contracted)


@query("G12_changed_projects", "SELECT name AS owner, count(*) AS paths FROM projects, (SELECT unnest(range(0, 3)) AS k) GROUP BY name")
def g12(t):
    paths = t.projects.select(F.explode(F.sequence(F.lit(0), F.lit(2))).alias("k"), "dir").select(F.concat("dir", F.lit("/f"), "k").alias("path"))
    return G.owner_of(paths, t.projects).groupBy("owner").agg(F.count("*").alias("paths"))


@query("G27b_all_restore_exclusions", "WITH RECURSIVE a AS (SELECT node FROM projects WHERE starts_with(dir, 'packages/b3/') UNION SELECT e.src FROM a JOIN edges e ON e.dst = a.node) SELECT node FROM a")
def g27b(t):
    return G.affected(t.projects.where(P.at_or_under("dir", "packages/b3")).select("node"), t.edges).select("node")


@query(
    "G28_download_modes",
    """WITH RECURSIVE d AS (SELECT dst AS node FROM edges WHERE src % 100 = 1 UNION SELECT e.dst FROM d JOIN edges e ON e.src = d.node)
       SELECT n.node, CASE WHEN n.node % 100 = 1 THEN 'now' WHEN n.node IN (SELECT node FROM d) THEN 'deferred' ELSE 'never' END AS mode FROM nodes n""",
)
def g28(t):
    asked = t.nodes.where("node % 100 = 1").select("node")
    below = G.closure(t.edges, asked).select("node").distinct().withColumn("below", F.lit(True))
    mode = F.when(F.expr("node % 100 = 1"), "now").when(F.col("below"), "deferred").otherwise("never")
    return t.nodes.select("node").join(shuffled(below), "node", "left").select("node", mode.alias("mode"))


@query("T5_component_order", "SELECT entry, kind, name, row_number() OVER (PARTITION BY entry ORDER BY kind, name) AS place FROM entry_inputs")
def t5(t):
    n = F.row_number().over(Window.partitionBy("entry").orderBy("kind", "name"))
    return t.entry_inputs.select("entry", "kind", "name", n.cast("long").alias("place"))


@query("S17b_batched_hashes", "SELECT r.hash, count(*) AS n, max(r.id) AS newest FROM runs r JOIN (SELECT DISTINCT hash FROM runs WHERE status = 'failed' AND hash <> '') f ON f.hash = r.hash GROUP BY r.hash")
def s17b(t):
    asked = t.runs.where("status = 'failed' AND hash <> ''").select("hash").distinct()
    return t.runs.join(asked, "hash").groupBy("hash").agg(F.count("*").alias("n"), F.max("id").alias("newest"))


@query(
    "G26_hub_edges",
    """SELECT 'direct' AS form, sum(n * (n - 1))::BIGINT AS edges FROM (SELECT count(*) AS n FROM edges GROUP BY dst) UNION ALL SELECT 'hub', sum(2 * n)::BIGINT FROM (SELECT count(*) AS n FROM edges GROUP BY dst)""",
)
def g26(t):
    # peers of one target meet in a hub node instead of pairwise
    n = t.edges.groupBy("dst").agg(F.count("*").alias("n"))
    to_hub = t.edges.select(F.col("src").alias("a"), (-F.col("dst") - 1).alias("b"))
    hub = to_hub.unionByName(to_hub.select(F.col("b").alias("a"), F.col("a").alias("b"))).agg(F.count("*").alias("edges")).select(F.lit("hub").alias("form"), "edges")
    return n.agg(F.sum(F.expr("n * (n - 1)")).alias("edges")).select(F.lit("direct").alias("form"), "edges").unionByName(hub)


@query("Q2_relations", " UNION ALL ".join(f"SELECT '{name}' AS relation, count(*) AS n FROM {name}" for name in RELATIONS))
def q2(t):
    out = None
    for name in RELATIONS:
        row = getattr(t, name).agg(F.count("*").alias("n")).select(F.lit(name).alias("relation"), "n")
        out = row if out is None else out.unionByName(row)
    return out


@query("R7_live_snapshot", "SELECT run_id, count(*) FILTER (WHERE started_at <= 1705708800000 AND ended_at > 1705708800000) AS running, count(*) FILTER (WHERE ended_at <= 1705708800000) AS done FROM runs GROUP BY run_id HAVING min(started_at) <= 1705708800000")
def r7(t):
    now = F.lit(1_705_708_800_000)
    n = lambda c: F.count(F.when(c, 1))
    g = t.runs.groupBy("run_id").agg(F.min("started_at").alias("s"), n((F.col("started_at") <= now) & (F.col("ended_at") > now)).alias("running"), n(F.col("ended_at") <= now).alias("done"))
    return g.where(F.col("s") <= now).drop("s")


@query(
    "Fs4_near_match_rules",
    """WITH n AS (SELECT id, CASE id % 4 WHEN 0 THEN upper(status) WHEN 1 THEN left(status, length(status) - 1) WHEN 2 THEN left(status, length(status) - 2) ELSE status || 'xyz' END AS name FROM runs),
        c AS (SELECT * FROM (VALUES (0, 'success'), (1, 'failed'), (2, 'skipped'), (3, 'cache-hit'), (4, 'cache-hit-remote')) v(i, c)),
        d AS (SELECT id, name, i, c, CASE WHEN c <> name AND lower(c) = lower(name) THEN -1 ELSE levenshtein(name, c) END AS d FROM n, c),
        k AS (SELECT id, arg_min(c, d * 10 + i) AS hint FROM d WHERE d = -1 OR d <= 2 AND d < greatest(length(name), length(c))
              AND NOT (length(name) <= 4 AND d = 2 AND list_sort(string_split(name, '')) <> list_sort(string_split(c, ''))) GROUP BY id)
       SELECT n.id, name, nullif(hint, name) AS hint FROM n LEFT JOIN k ON k.id = n.id""",
)
def fs4(t):
    typed = F.expr("CASE id % 4 WHEN 0 THEN upper(status) WHEN 1 THEN left(status, length(status) - 1) WHEN 2 THEN left(status, length(status) - 2) ELSE concat(status, 'xyz') END")
    r = t.runs.select("id", typed.alias("name"))
    return r.select("id", "name", X.nearest(F.col("name"), ["success", "failed", "skipped", "cache-hit", "cache-hit-remote"]).alias("hint"))


@query(
    "Fs16_two_stream_log",
    """SELECT doc_id, sha256(a || chr(30) || 'e' || 'x' || chr(30) || chr(30) || 'y' || CASE WHEN b <> '' THEN chr(30) || 'o' || b ELSE '' END) AS log_sha256,
         (a <> '')::INT + 1 + (b <> '')::INT AS chunks, 'x' || chr(30) || 'y' AS err, a || b AS shown
       FROM (SELECT doc_id, left(coalesce(text, ''), 50) AS a, substr(coalesce(text, ''), 51) AS b FROM documents)""",
)
def fs16(t):
    d = t.table("documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    chunk = lambda err, text: F.struct(F.lit(err).alias("err"), text.alias("text"))
    made = F.array(chunk(False, F.left("text", F.lit(50))), chunk(True, F.lit("x\x1ey")), chunk(False, F.substring("text", 51, 1 << 30)))
    d = d.select("doc_id", X.log_of(F.filter(made, lambda c: c["text"] != "")).alias("log"))
    d = d.select("doc_id", "log", X.chunks_of_log(F.col("log")).alias("c"))
    of = lambda err: F.array_join(F.transform(F.filter("c", lambda c: c["err"] == err), lambda c: c["text"]), "")
    return d.select("doc_id", F.sha2("log", 256).alias("log_sha256"), F.size("c").alias("chunks"), of(True).alias("err"), of(False).alias("shown"))


@query("Fh2_sorted_json", """SELECT id, '{"a":[{"c":' || cores || ',"d":"' || task || '"}],"m":{"b":null,"y":true},"z":' || id || '}' AS json FROM runs""")
def fh2(t):
    text = F.format_string('{"z": %d, "m": {"y": true, "b": null}, "a": [{"d": "%s", "c": %d}]}', "id", "task", "cores")
    return t.runs.select("id", X.sorted_json(text).alias("json"))


@query(
    "Fh3_definition_hash",
    """SELECT id, CASE WHEN def IS NOT NULL THEN sha256(project || '#' || task || chr(31) || def || chr(31) || CASE WHEN id % 2 = 0 THEN '[["A","' || cores || '"],["B","' || task || '"]]' ELSE '[]' END) END AS def_hash FROM runs""",
)
def fh3(t):
    define = F.when(F.expr("id % 2 = 0"), F.create_map(F.lit("B"), "task", F.lit("A"), F.col("cores").cast("string")))
    return t.runs.select("id", X.definition_hash(F.concat_ws("#", "project", "task"), F.col("def"), define).alias("def_hash"))


@query(
    "K4_upsert_fold",
    f"""SELECT project, task, {', '.join(f'CASE WHEN o.duration_ms IS NULL THEN {first} WHEN d IS NULL OR NOT {MOVED} THEN {k} ELSE {FOLD[k]} END AS {k}' for k, first in (('duration_ms', 'd'), ('cores', 'c'), ('rss', 'r'), ('slow_ms', 'd'), ('runs', '1'), ('updated_at', 't')))}
        FROM (SELECT project, task, hash, min(duration_ms) AS duration_ms, max(cores)::DOUBLE AS cores, min(peak_rss) AS rss, max(duration_ms) AS slow_ms, count(*) AS runs, max(started_at) AS updated_at FROM runs WHERE status = 'failed' GROUP BY ALL) o
        FULL JOIN (SELECT project, task, hash, max(duration_ms) AS d, CASE WHEN max(id) % 3 <> 0 THEN avg(cores) END AS c, CASE WHEN max(id) % 4 <> 0 THEN max(peak_rss) END AS r, max(started_at) AS t FROM runs WHERE status = 'success' GROUP BY ALL) n USING (project, task, hash)""".replace("SELECT project, task, CASE", "SELECT project, task, hash, CASE", 1),
)
def k4(t):
    by = ["project", "task", "hash"]
    old = t.runs.where("status = 'failed'").groupBy(*by).agg(
        F.min("duration_ms").alias("duration_ms"), F.max("cores").cast("double").alias("cores"), F.min("peak_rss").alias("rss"), F.max("duration_ms").alias("slow_ms"), F.count("*").alias("runs"), F.max("started_at").alias("updated_at")
    )
    new = t.runs.where("status = 'success'").groupBy(*by).agg(
        F.max("duration_ms").alias("d"), F.expr("IF(max(id) % 3 <> 0, avg(cores), NULL)").alias("c"), F.expr("IF(max(id) % 4 <> 0, max(peak_rss), NULL)").alias("r"), F.max("started_at").alias("at")
    )
    return FC.server_upsert(old, new, *by)


@query("K11_trace_events", """SELECT id, '{"name":"' || id || '","ph":"X","ts":' || start * 1000 || ',"dur":' || (stop - start) * 1000 || ',"pid":' || worker || ',"args":{"cores":' || cores || '}}' AS event FROM spans""")
def k11(t):
    slice_ = F.struct(
        F.col("id").cast("string").alias("name"), F.lit("X").alias("ph"), (F.col("start") * 1000).alias("ts"), ((F.col("stop") - F.col("start")) * 1000).alias("dur"), F.col("worker").alias("pid"), F.struct("cores").alias("args")
    )
    return t.spans.select("id", F.to_json(slice_).alias("event"))


@query("S10_packed_hits", "SELECT run_id, id, project, status FROM runs WHERE cache_hit")
def s10(t):
    # a run's hits packed into one text each, then unpacked into rows
    hits = t.runs.where("cache_hit").groupBy("run_id").agg(F.to_json(F.collect_list(F.struct("id", "project", "status"))).alias("packed"))
    return hits.select("run_id", F.inline(F.from_json("packed", "array<struct<id bigint, project string, status string>>")))


@query("U5_overlay", "SELECT project, task, coalesce(n.ms, o.ms) AS ms FROM (SELECT project, task, max(duration_ms) AS ms FROM runs WHERE run_id < '2024011500' GROUP BY ALL) o FULL JOIN (SELECT project, task, max(duration_ms) AS ms FROM runs WHERE run_id >= '2024011500' AND status = 'success' GROUP BY ALL) n USING (project, task)")
def u5(t):
    by = lambda rows, name: rows.groupBy("project", "task").agg(F.max("duration_ms").alias(name))
    carried, new = by(t.runs.where("run_id < '2024011500'"), "old"), by(t.runs.where("run_id >= '2024011500' AND status = 'success'"), "new")
    return carried.join(new, ["project", "task"], "full").select("project", "task", F.coalesce("new", "old").alias("ms"))


@query("W4_neighbours", "SELECT id, lag(id) OVER w AS before, lead(id) OVER w AS after FROM runs WHERE hash <> '' WINDOW w AS (PARTITION BY project, task ORDER BY id)")
def w4(t):
    rows = t.runs.where("hash <> ''").select("id", "project", "task")
    both = TL.neighbour(TL.neighbour(rows, F.col("id"), "project", "task").withColumnRenamed("_near", "before"), F.col("id"), "project", "task", later=True)
    return both.select("id", "before", F.col("_near").alias("after"))
