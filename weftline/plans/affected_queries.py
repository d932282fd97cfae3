"""What changed paths reach: tasks by their inputs, projects as a whole, and along task edges."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import affected as AF
from ..operators import graph as G
from ..sources.shared import shuffled, written
from .registry import query

#: Changed paths below a project's directory, by the cost of its node.
CHANGED = {1: "src/a/b.ts", 7: "README.md", 11: "src/gone.md", 13: "tests/x.ts", 18: "src/q.ts", 14: "tests/t.ts", 20: "any.txt", 26: "package.json", 31: ".gitattributes"}

REACHED = f"""b AS (SELECT p.node, p.name, p.dir, n.cost AS c FROM projects p JOIN nodes n ON n.node = p.node),
    tasks AS (SELECT node * 10 + k AS id, node, name, k, c FROM b, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE CASE k WHEN 1 THEN c % 5 IN (1, 2, 3) WHEN 2 THEN c % 5 IN (1, 2, 4) WHEN 3 THEN c % 5 = 3 ELSE c % 5 = 4 END),
    changed AS (SELECT node, dir || '/' || rel AS path, rel FROM b JOIN (VALUES {", ".join(f"({c}, '{rel}')" for c, rel in CHANGED.items())}) v(c, rel) ON v.c = b.c),
    decl AS (SELECT t.id, t.node, ch.path FROM tasks t JOIN changed ch ON ch.node = t.node WHERE (k = 1 AND rel LIKE 'src/%' AND rel <> 'src/gone.md') OR (k = 2 AND regexp_matches(rel, '^(src|tests)/'))),
    whole AS (SELECT ch.node, min(ch.path) AS file FROM changed ch LEFT JOIN decl d ON d.node = ch.node AND d.path = ch.path WHERE d.id IS NULL OR ch.rel = 'package.json' GROUP BY ch.node),
    w AS (SELECT src AS origin, dst AS goal FROM edges WHERE src IN (SELECT node FROM tasks WHERE k = 1) UNION SELECT w.origin, e.dst FROM w JOIN edges e ON e.src = w.goal WHERE w.goal NOT IN (SELECT node FROM tasks WHERE k = 1)),
    te AS (SELECT origin * 10 + 1 AS src, goal * 10 + 1 AS dst FROM w WHERE goal IN (SELECT node FROM tasks WHERE k = 1) UNION SELECT id, node * 10 + 1 FROM tasks WHERE (k = 2 AND c % 5 <> 4) OR k = 3 UNION SELECT id, node * 10 + 2 FROM tasks WHERE k = 4),
    pk AS (SELECT origin * 10 + 1 AS id, min(b.name) AS package FROM w JOIN b ON b.node = w.goal WHERE c = 20 GROUP BY origin),
    f AS (SELECT t.id, t.k, t.c, t.k = 2 AND t.c % 5 = 4 AND t.node % 7 = 3 AS far, (SELECT min(path) FROM changed ch WHERE ch.node = t.node) AS first, whole.file AS whole, d.near, pk.package
          FROM tasks t LEFT JOIN whole ON whole.node = t.node LEFT JOIN (SELECT id, min(path) AS near FROM decl GROUP BY id) d ON d.id = t.id LEFT JOIN pk ON pk.id = t.id),
    seeds AS (SELECT id, CASE WHEN far THEN 'input' WHEN k = 3 THEN 'project' WHEN c = 31 THEN 'workspace' WHEN whole IS NOT NULL THEN 'project' WHEN near IS NOT NULL THEN 'input' ELSE 'package' END AS kind,
                CASE WHEN far THEN 'docs/p3/x.md' WHEN k = 3 THEN first ELSE coalesce(whole, near) END AS file, CASE WHEN NOT far AND whole IS NULL AND near IS NULL THEN package END AS project
              FROM f WHERE far OR (k = 3 AND first IS NOT NULL) OR (k < 3 AND (whole IS NOT NULL OR near IS NOT NULL)) OR package IS NOT NULL),
    r AS (SELECT id FROM seeds UNION SELECT te.src FROM r JOIN te ON te.dst = r.id),
    through AS (SELECT te.src AS id, min(te.dst) AS next FROM te JOIN r ON r.id = te.dst WHERE te.src NOT IN (SELECT id FROM seeds) GROUP BY te.src),
    ways AS (SELECT id AS root, next AS goal, 1 AS place FROM through UNION ALL SELECT ways.root, through.next, ways.place + 1 FROM ways JOIN through ON through.id = ways.goal),
    asked AS (SELECT id, CASE WHEN node % 41 = 0 THEN 'named' WHEN c = 47 THEN 'selected' END AS own FROM tasks WHERE k > 1)"""


def _reached(t):
    p = t.projects.join(shuffled(t.nodes.select("node", F.col("cost").alias("c"))), "node")
    has = F.when(F.expr("c % 5 IN (1, 2)"), F.array(F.lit(1), F.lit(2))).when(F.expr("c % 5 = 3"), F.array(F.lit(1), F.lit(3))).when(F.expr("c % 5 = 4"), F.array(F.lit(2), F.lit(4)))
    rows = p.select("node", "name", "c", F.explode(has).alias("k")).withColumn("id", (F.col("node") * 10 + F.col("k")).cast("long"))
    tasks = rows.select(F.col("id").alias("node"), F.col("name").alias("project"), F.element_at(F.array(*map(F.lit, ("build", "test", "lint", "all"))), F.col("k")).alias("task"), (F.col("k") == 4).alias("grouped"))
    says = {1: [("project", "src/**"), ("project", "!src/gone.md")], 2: [("project", "./{src,tests}/**")]}
    literal = t.spark.createDataFrame([(k, *s) for k, ss in says.items() for s in ss], "k int, scope string, pattern string")
    inputs = rows.join(F.broadcast(literal), "k").select(F.col("id").alias("node"), "scope", "pattern")
    inputs = inputs.unionByName(rows.where("k = 2 AND c % 5 = 4").select(F.col("id").alias("node"), F.lit("workspace").alias("scope"), F.concat(F.lit("docs/p"), F.expr("node % 7"), F.lit("/*.md")).alias("pattern")))
    below = t.spark.createDataFrame(list(CHANGED.items()), "c long, rel string")
    changed = p.join(F.broadcast(below), "c").select(F.concat_ws("/", "dir", "rel").alias("path")).unionByName(p.where("node = 3").select(F.lit("docs/p3/x.md").alias("path")))

    builds = rows.where("k = 1").select("node")
    up = G.nearest_holders(t.edges, builds, builds).select((F.col("origin") * 10 + 1).cast("long").alias("src"), (F.col("node") * 10 + 1).cast("long").alias("dst"))
    beside = rows.where("(k = 2 AND c % 5 <> 4) OR k > 2").select(F.col("id").alias("src"), F.expr("node * 10 + IF(k = 4, 2, 1)").cast("long").alias("dst"))
    name = lambda end: t.projects.select(F.col("node").alias(end), F.col("name").alias(f"{end}_name"))
    packages = t.edges.join(shuffled(name("src")), "src").join(shuffled(name("dst")), "dst").select(F.col("src_name").alias("src"), F.col("dst_name").alias("dst"))
    specs = rows.where("k = 1").select(F.col("id").alias("node"), F.lit("build").alias("name"))
    asked = rows.where("k > 1").select(F.col("id").alias("node"), F.expr("node % 41 = 0").alias("named"), F.expr("c = 47").alias("outright"))
    return AF.affected_tasks(tasks, t.projects.select(F.col("name").alias("project"), "dir"), inputs, changed, written(up.unionByName(beside)), specs, packages, asked)


@query(
    "G10b_affected_tasks",
    f"""WITH RECURSIVE {REACHED}, ends AS (SELECT root AS id, arg_max(goal, place) AS seed, max(place) AS hops FROM ways GROUP BY root UNION ALL SELECT id, id, 0 FROM seeds)
       SELECT a.id AS node, coalesce(own, s.kind) AS kind, CASE WHEN own IS NULL THEN s.file END AS file, CASE WHEN own IS NULL THEN s.project END AS project, CASE WHEN own IS NULL THEN e.seed END AS seed,
         CASE WHEN own IS NULL THEN h.next END AS next, CASE WHEN own IS NULL THEN e.hops END::BIGINT AS hops
       FROM asked a LEFT JOIN ends e ON e.id = a.id LEFT JOIN seeds s ON s.id = e.seed LEFT JOIN through h ON h.id = a.id WHERE own IS NOT NULL OR e.id IS NOT NULL""",
)
def g10b(t):
    return _reached(t)[0]


@query("G10c_affected_chains", f"WITH RECURSIVE {REACHED} SELECT root, place::BIGINT AS place, goal AS node FROM ways WHERE root IN (SELECT id FROM asked WHERE own IS NULL)")
def g10c(t):
    return AF.chains(*_reached(t))
