"""Graph walks, priorities, ownership and selection over the package graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph as G
from ..operators import selection as SEL
from .registry import query

CLOSURE = "c AS (SELECT src AS origin, dst AS node FROM edges UNION SELECT c.origin, e.dst FROM c JOIN edges e ON c.node = e.src)"


@query("G1_clean_edges", "SELECT src, dst FROM edges WHERE src IN (SELECT node FROM nodes) AND dst IN (SELECT node FROM nodes)")
def g1(t):
    dirty = t.edges.unionByName(t.edges).unionByName(t.nodes.select(F.col("node").alias("src"), F.col("node").alias("dst")))
    dirty = dirty.unionByName(t.nodes.select(F.col("node").alias("src"), (-F.col("node") - 1).alias("dst")))
    return G.clean_edges(dirty, t.nodes)


@query("G2_closure", f"WITH RECURSIVE {CLOSURE} SELECT origin, node FROM c")
def g2(t):
    return G.closure(t.edges)


@query("G3_dependent_counts", f"WITH RECURSIVE {CLOSURE} SELECT n.node, count(c.origin) AS dependents FROM nodes n LEFT JOIN c ON c.node = n.node GROUP BY n.node")
def g3(t):
    return G.dependent_counts(t.nodes, t.edges)


PATHS = """p AS (SELECT node, COST AS path FROM nodes UNION SELECT e.dst, p.path + n.COST FROM p JOIN edges e ON e.src = p.node JOIN nodes n ON n.node = e.dst)"""


@query("G5_depths", f"WITH RECURSIVE {PATHS.replace('n.COST', '1').replace('COST', '0')} SELECT node, max(path)::BIGINT AS depth FROM p GROUP BY node")
def g5(t):
    return G.depths(t.nodes, t.edges)


@query("G5b_direct_dependents", "SELECT n.node, count(e.src) AS direct FROM nodes n LEFT JOIN edges e ON e.dst = n.node GROUP BY n.node")
def g5b(t):
    return G.direct_dependents(t.nodes, t.edges)


@query("G6_merged_priority", "SELECT node, CASE WHEN node % 3 = 0 THEN (node % 7 - 3 - least(0, (SELECT min(node % 7 - 3) FROM nodes WHERE node % 3 = 0)) + 1) * 1048576 + cost ELSE cost END AS priority FROM nodes")
def g6(t):
    w = t.nodes.where("node % 3 = 0").select("node", F.expr("node % 7 - 3").alias("weight"))
    return G.merged_priority(t.nodes, w, t.nodes.select("node", F.col("cost").alias("base")))


@query("G7_critical_path", f"WITH RECURSIVE {PATHS.replace('COST', 'cost')} SELECT node, any_value(n.cost) AS cost, max(path)::BIGINT AS path FROM p JOIN nodes n USING (node) GROUP BY node")
def g7(t):
    return G.longest_paths(t.nodes, t.edges)


@query("G8_predicted_plan", f"WITH RECURSIVE {PATHS.replace('COST', 'cost')} SELECT max(path)::BIGINT AS longest, (SELECT sum(cost)::BIGINT FROM nodes) AS work, (SELECT count(*) FROM nodes WHERE cost = 0) AS unknown FROM p")
def g8(t):
    return G.chain(G.longest_paths(t.nodes, t.edges), t.edges)


@query("G9_forecast_eta", f"WITH RECURSIVE {PATHS.replace('COST', 'cost')} SELECT greatest(max(path), (SELECT sum(cost) / 8 FROM nodes)) AS eta FROM p")
def g9(t):
    p = G.chain(G.longest_paths(t.nodes, t.edges), t.edges)
    return p.select(F.greatest(F.col("longest").cast("double"), F.col("work") / 8).alias("eta"))


SEEDS = "s AS (SELECT node FROM nodes WHERE node IN (3, 10, 55))"
AFFECTED = f"{SEEDS}, a AS (SELECT node, 0 AS hops FROM s UNION SELECT e.src, a.hops + 1 FROM a JOIN edges e ON e.dst = a.node)"


def _seeds(t):
    return t.nodes.where("node IN (3, 10, 55)").select("node")


@query("G10_affected", f"WITH RECURSIVE {AFFECTED}, h AS (SELECT node, min(hops) AS hops FROM a GROUP BY node) SELECT h.node, h.hops::INT AS hops, CASE WHEN h.hops > 0 THEN (SELECT min(e.dst) FROM edges e JOIN h b ON b.node = e.dst WHERE e.src = h.node AND b.hops = h.hops - 1) END AS via FROM h")
def g10(t):
    return G.affected(_seeds(t), t.edges)


@query("G11_kept_by_affected", f"WITH RECURSIVE {AFFECTED} SELECT node, CASE WHEN node % 5 = 0 THEN 'named' WHEN min(hops) = 0 THEN 'changed' ELSE 'reached' END AS reason FROM a GROUP BY node UNION SELECT node, 'named' FROM nodes WHERE node % 5 = 0")
def g11(t):
    a = G.affected(_seeds(t), t.edges)
    named = t.nodes.where("node % 5 = 0").select("node", F.lit("named").alias("named"))
    return a.join(named, "node", "full").select("node", F.coalesce("named", F.when(F.col("hops") == 0, "changed").otherwise("reached")).alias("reason"))


@query("G13_selected", f"WITH RECURSIVE d AS (SELECT node FROM nodes WHERE node % 97 = 5 UNION SELECT e.dst FROM d JOIN edges e ON e.src = d.node) SELECT node FROM d WHERE node % 2 = 1")
def g13(t):
    picked = SEL.with_dependencies(t.nodes.where("node % 97 = 5").select("node"), t.edges)
    return SEL.without(picked, t.nodes.where("node % 2 = 0"))


@query("G14_root_causes", f"WITH RECURSIVE d AS (SELECT node FROM nodes WHERE node = 150 UNION SELECT e.dst FROM d JOIN edges e ON e.src = d.node WHERE e.dst % 4 <> 0) SELECT node FROM d WHERE node <> 150 AND NOT EXISTS (SELECT 1 FROM edges e WHERE e.src = d.node AND e.dst % 4 <> 0)")
def g14(t):
    moved = t.edges.where("dst % 4 <> 0")
    reached = G.closure(moved, t.nodes.where("node = 150")).select("node").distinct()
    return reached.join(moved.select(F.col("src").alias("node")), "node", "left_anti")


TAINT = "x AS (SELECT node, node AS root FROM nodes WHERE node IN (7, 20, 33) UNION SELECT e.src, x.root FROM x JOIN edges e ON e.dst = x.node)"


@query("G15_tainted", f"WITH RECURSIVE {TAINT} SELECT node, min(root) AS root FROM x GROUP BY node")
def g15(t):
    return G.tainted(t.nodes.where("node IN (7, 20, 33)").select("node"), t.edges)


@query("G16_skipped", f"WITH RECURSIVE {TAINT} SELECT n.node, min(x.root) AS blocker, CASE WHEN min(x.root) IS NULL THEN 'run' ELSE 'skip' END AS plan FROM nodes n LEFT JOIN x ON x.node = n.node GROUP BY n.node")
def g16(t):
    b = G.tainted(t.nodes.where("node IN (7, 20, 33)").select("node"), t.edges).withColumnRenamed("root", "blocker")
    return t.nodes.select("node").join(b, "node", "left").select("node", "blocker", F.when(F.col("blocker").isNull(), "run").otherwise("skip").alias("plan"))


@query("G17_through_groups", "WITH RECURSIVE w AS (SELECT src AS origin, dst AS node FROM edges WHERE src % 3 <> 0 UNION SELECT w.origin, e.dst FROM w JOIN edges e ON e.src = w.node WHERE w.node % 3 = 0) SELECT origin, node FROM w WHERE node % 3 <> 0")
def g17(t):
    commands = t.nodes.where("node % 3 <> 0").select("node")
    return G.nearest_holders(t.edges, commands, commands)


@query("G18_nearest_holders", "WITH RECURSIVE w AS (SELECT src AS origin, dst AS node FROM edges WHERE src IN (90, 133, 180) UNION SELECT w.origin, e.dst FROM w JOIN edges e ON e.src = w.node WHERE w.node % 5 <> 0) SELECT origin, node FROM w WHERE node % 5 = 0")
def g18(t):
    return G.nearest_holders(t.edges, t.nodes.where("node % 5 = 0"), t.nodes.where("node IN (90, 133, 180)").select("node"))


@query("G18b_all_nearest_holders", "WITH RECURSIVE w AS (SELECT src AS origin, dst AS node FROM edges UNION SELECT w.origin, e.dst FROM w JOIN edges e ON e.src = w.node WHERE w.node % 5 <> 0) SELECT origin, node FROM w WHERE node % 5 = 0")
def g18b(t):
    return G.nearest_holders(t.edges, t.nodes.where("node % 5 = 0"), t.nodes.select("node"))


@query("G19_cycles", "SELECT src, dst FROM (SELECT 100001 AS src, 100002 AS dst UNION ALL SELECT 100002, 100003 UNION ALL SELECT 100003, 100001)")
def g19(t):
    loop = t.spark.createDataFrame([(100001, 100002), (100002, 100003), (100003, 100001)], "src int, dst int")
    return G.cyclic(t.edges.select(F.col("src").cast("int").alias("src"), F.col("dst").cast("int").alias("dst")).unionByName(loop))


@query("G20_overlapping_outputs", "SELECT a.dir AS outer, b.dir || '/src' AS inner FROM projects a JOIN projects b ON b.dir = a.dir")
def g20(t):
    dirs = t.projects.select("dir").unionByName(t.projects.select(F.concat("dir", F.lit("/src")).alias("dir")))
    return G.nested_dirs(dirs)


@query("G21_restricted_closure", "WITH RECURSIVE r AS (SELECT src AS origin, dst AS node FROM edges WHERE src IN (150, 199) UNION SELECT r.origin, e.dst FROM r JOIN edges e ON e.src = r.node WHERE r.node % 2 = 1) SELECT origin, node FROM r")
def g21(t):
    return G.restricted_closure(t.edges, t.nodes.where("node % 2 = 1"), t.nodes.where("node IN (150, 199)").select("node"))


@query("G21b_all_restricted_closures", "WITH RECURSIVE r AS (SELECT src AS origin, dst AS node FROM edges UNION SELECT r.origin, e.dst FROM r JOIN edges e ON e.src = r.node WHERE r.node % 2 = 1) SELECT origin, node FROM r")
def g21b(t):
    return G.restricted_closure(t.edges, t.nodes.where("node % 2 = 1"), t.nodes.select("node"))


@query("G22_likely_misses", f"WITH RECURSIVE {AFFECTED} SELECT DISTINCT node FROM a")
def g22(t):
    return G.affected(_seeds(t), t.edges).select("node")


@query("G23_folded_once", "SELECT dst AS unit, count(*) AS users, min(src) AS first FROM edges GROUP BY dst")
def g23(t):
    return t.edges.groupBy(F.col("dst").alias("unit")).agg(F.count("*").alias("users"), F.min("src").alias("first"))


@query("G25_reach_digests")
def g25(t):
    return G.reach_digests(t.nodes, t.edges)


@query("J16_owner", "SELECT dir || '/src/f' || (node % 3) || '.ts' AS path, name AS owner FROM projects")
def j16(t):
    paths = t.projects.select(F.concat("dir", F.lit("/src/f"), F.expr("node % 3"), F.lit(".ts")).alias("path"))
    return G.owner_of(paths, t.projects)


@query("J17_nested_dirs", "SELECT DISTINCT 'packages/b' || (node % 7) AS outer, dir AS inner FROM projects")
def j17(t):
    tops = t.projects.select(F.concat(F.lit("packages/b"), F.expr("node % 7")).alias("dir")).distinct()
    return G.nested_dirs(t.projects.select("dir").unionByName(tops))


@query("J18_rule_breaks", "SELECT DISTINCT e.src, e.dst, a.t AS from_tag, b.t AS to_tag FROM edges e JOIN (SELECT node, unnest(tags) AS t FROM projects) a ON a.node = e.src JOIN (SELECT node, unnest(tags) AS t FROM projects) b ON b.node = e.dst WHERE (a.t, b.t) IN (('Brand#11', 'Brand#21'), ('Brand#12', 'Brand#31'))")
def j18(t):
    rules = t.spark.createDataFrame([("Brand#11", "Brand#21"), ("Brand#12", "Brand#31")], "from_tag string, to_tag string")
    return SEL.rule_breaks(t.edges, t.projects, F.broadcast(rules))


@query("P13_bare_name", "SELECT node, name FROM projects WHERE name = '@s4/lib-4' UNION ALL SELECT node, name FROM projects WHERE name = 'lib-7'")
def p13(t):
    return SEL.by_name(t.projects, "lib-4").unionByName(SEL.by_name(t.projects, "lib-7")).select("node", "name")


@query("T2_ready_order", f"WITH RECURSIVE {PATHS.replace('COST', 'cost')}, m AS (SELECT node, max(path)::BIGINT AS path FROM p GROUP BY node) SELECT node, path, row_number() OVER (ORDER BY path DESC, node)::INT AS place FROM m ORDER BY path DESC, node LIMIT 20")
def t2(t):
    return G.ranked_by_path(G.longest_paths(t.nodes, t.edges), 20).select("node", "path", "place")
