"""Closures, critical paths and propagation over (src, dst) edges; src depends on dst.

All are frontier iterations: each round joins only what is new to the edges.
Rounds are written as tables in the shared folder, which survive a lost
executor; the number of rounds is the depth of the graph.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import Buckets, shared_folder, shuffled
from ..sources.shared import written as checkpointed


def clean_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Without self edges, repeats and edges of unknown nodes."""
    known = nodes.select("node")
    e = edges.where(F.col("src") != F.col("dst")).distinct()
    return e.join(known.withColumnRenamed("node", "src"), "src", "left_semi").join(known.withColumnRenamed("node", "dst"), "dst", "left_semi").select("src", "dst")


#: Rounds of three peels within which a graph is shallow.
PEELS = 22


def shallow(edges: DataFrame) -> bool:
    """Whether edges have no cycle and no way of over 3 * PEELS steps: told by peeling nodes without dependencies."""
    left = checkpointed(edges.select("src", "dst").distinct())
    n = left.count()
    for _ in range(PEELS):
        if not n:
            return True
        for _ in range(3):
            left = left.join(shuffled(left.select(F.col("src").alias("dst")).distinct()), "dst", "left_semi").select("src", "dst")
        left, before = checkpointed(left), n
        n = left.count()
        if n == before:
            return False
    return not n


def walks(start: DataFrame, edges: DataFrame) -> DataFrame:
    """(origin, node) as `reached`, for shallow edges: a round takes the ends of all ways of one length to those one longer.

    Nothing is looked up in the rounds before: pairs of several lengths fall
    together at the end, so each pair is shuffled a few times whatever the depth.
    """
    return _pairs(_ways(start.withColumn("last", F.lit(False)), edges.withColumn("last", F.lit(False))))


def _pairs(ways: DataFrame) -> DataFrame:
    """(origin, node) of ways, each once, as they lie in their buckets."""
    return ways.select("origin", "node", *(["part"] if "part" in ways.columns else [])).distinct().select("origin", "node")


#: Edges of a bucket of the ways, and of a walk for which the origins of a node are one part more.
BUCKET, PART = 50_000, 2_000_000


def _ways(start: DataFrame, edges: DataFrame) -> DataFrame:
    """(origin, node, last) of ways of each length in turn; no way goes on from an edge (src, dst, last) that is marked as its last.

    A node is a way's last whatever edge leads to it, so a pair has one mark.
    Pairs of several lengths come several times. Ways and edges lie in buckets
    of the node that joins them: only what a round adds is shuffled, to the
    bucket of its node, and what comes several times falls together there. A
    node that all others reach would be one bucket, so in large graphs its
    origins are dealt to several (part), and each meets the edges there.
    """
    spark, many = edges.sparkSession, edges.count()
    n = min(max(int(spark.conf.get("spark.sql.shuffle.partitions")), many // BUCKET), 20_000)
    parts = 1 + many // PART
    by, e_by = (["node"], ["e_src"]) if parts == 1 else (["node", "part"], ["e_src", "e_part"])
    dealt = lambda df: df if parts == 1 else df.withColumn("part", F.pmod(F.xxhash64("origin"), F.lit(parts)).cast("int"))
    to = edges.select(F.col("src").alias("e_src"), F.col("dst").alias("e_dst"), F.col("last").alias("e_last"))
    if parts > 1:  # ways go on from where an edge leads
        to = to.join(shuffled(edges.select(F.col("dst").alias("e_src")).union(start.select("dst")).distinct()), "e_src", "left_semi")
        to = to.withColumn("e_part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    steps, ways = Buckets(spark, e_by, n), Buckets(spark, by, n)
    steps.append(to.repartition(n, *e_by))
    e, hops = shuffled(steps.closed()), 0
    new = start.select(F.col("src").alias("origin"), F.col("dst").alias("node"), "last")
    meet = [F.col(w) == F.col(x) for w, x in zip(by, e_by, strict=True)]
    while True:
        ways.append(dealt(new).repartition(n, *by).distinct().withColumn("hops", F.lit(hops)))
        on = ways.read().where(F.col("hops") == hops)
        if on.isEmpty():
            return ways.closed().drop("hops")
        new = on.where(~F.col("last")).join(e, meet).select("origin", F.col("e_dst").alias("node"), F.col("e_last").alias("last"))
        hops += 1


def _marked(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(src, dst, within): each edge once, and whether its dst is one of the nodes."""
    have = nodes.select(F.col("node").alias("dst")).distinct().withColumn("within", F.lit(True))
    return checkpointed(edges.select("src", "dst").distinct().join(shuffled(have), "dst", "left").select("src", "dst", F.col("within").isNotNull().alias("within")))


def closure(edges: DataFrame, seeds: DataFrame | None = None) -> DataFrame:
    """(origin, node): everything that each seed, or each src, reaches. On a cycle a node reaches itself.

    From all nodes of a shallow graph by ways of one length after the other,
    else by doubling: what lies more than n and at most 2n steps away is what
    lies at most n steps from the nodes exactly n away. So the rounds are the
    logarithm of the depth, and each joins what is exactly as far as the round
    before came. From seeds, step by step.
    """
    if seeds is not None:
        return reached(edges.join(shuffled(seeds.select(F.col("node").alias("src"))), "src", "left_semi"), edges)
    edges = checkpointed(edges.select("src", "dst").distinct())
    return walks(edges, edges) if shallow(edges) else _doubled(edges)


def _doubled(edges: DataFrame) -> DataFrame:
    seen, far = checkpointed(edges.select(F.col("src").alias("origin"), F.col("dst").alias("node"), F.lit(1).alias("hops")).distinct()), 1
    while True:
        edge = seen.where(F.col("hops") == far).select("origin", F.col("node").alias("mid"))
        on = seen.select(F.col("origin").alias("mid"), "node", F.col("hops").alias("more"))
        step = edge.join(shuffled(on), "mid").groupBy("origin", "node").agg((F.min("more") + far).alias("hops"))
        new = checkpointed(step.join(shuffled(seen.select("origin", "node")), ["origin", "node"], "left_anti"))
        if new.isEmpty():
            return seen.select("origin", "node")
        seen, far = seen.unionByName(new), far * 2


#: Jumps that edges may be squared to, as a multiple of their number, and how often.
GROWTH, SQUARES = 8, 16


def jumps(edges: DataFrame, gain: str | None = None) -> DataFrame:
    """edges (src, dst, gain) and jumps of 2, 4, 8 steps and so on, each with the largest sum of gains on a way of so many.

    What spreads along edges spreads as far along jumps in fewer rounds.
    Squaring stops where it would make more than GROWTH times the edges, so
    that a dense graph isn't multiplied.
    """
    g = F.col(gain) if gain else F.lit(0)
    level = checkpointed(edges.select("src", "dst", g.alias("gain")).distinct())
    most, every = GROWTH * level.count(), level
    for _ in range(SQUARES):
        on = level.select(F.col("src").alias("dst"), F.col("dst").alias("to"), F.col("gain").alias("more"))
        level = checkpointed(level.join(shuffled(on), "dst").groupBy("src", F.col("to").alias("dst")).agg(F.max(F.col("gain") + F.col("more")).alias("gain")))
        n = level.count()
        if not n or n > most:
            break
        every = every.unionByName(level)
    return every


def reached(start: DataFrame, edges: DataFrame) -> DataFrame:
    """(origin, node): what each origin reaches from its first steps, start's (src, dst); an origin needn't be a node."""
    e = shuffled(edges.select(F.col("src").alias("e_src"), F.col("dst").alias("e_dst")))
    new = checkpointed(start.select(F.col("src").alias("origin"), F.col("dst").alias("node")).distinct())
    seen = new
    while not new.isEmpty():
        step = new.join(e, new["node"] == e["e_src"]).select("origin", F.col("e_dst").alias("node")).distinct()
        new = checkpointed(step.join(shuffled(seen), ["origin", "node"], "left_anti"))
        seen = seen.unionByName(new)
    return seen


#: Steps of one round of `strides`.
STRIDE = 5


def laid(edges: DataFrame) -> tuple[DataFrame, int]:
    """Edges as a table in buckets of their src, for `strides`, and how many buckets."""
    n = min(max(int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")), edges.count() // BUCKET), 20_000)
    # told here, else a step that another joins would be told so, and be another step than the same one in the result
    return in_buckets(edges.select(F.col("src").alias("e_src"), F.col("dst").alias("e_dst")), "e_src", n).where("e_src IS NOT NULL AND e_dst IS NOT NULL"), n


def in_buckets(df: DataFrame, by: str, n: int) -> DataFrame:
    """df as a table in n buckets of a column, the side of joins that sort both."""
    out = Buckets(df.sparkSession, [by], n)
    out.append(df.repartition(n, by))
    return shuffled(out.closed())


def strides(start: DataFrame, steps: tuple[DataFrame, int]) -> DataFrame:
    """(origin, node): what start (origin, node) reaches in one step or more, STRIDE steps a round, any graph.

    A round is one job whose steps feed each other, and what it finds is
    looked up once in what was found before. Pairs first met at its last step
    go on in the next round; those before it have gone on in this one.
    """
    (e, n), rounds = steps, 0
    seen, new = Buckets(start.sparkSession, ["node"], n), start.select("origin", "node").repartition(n, "node").distinct()
    while True:
        found, at = None, new
        for hop in range(1, STRIDE + 1):
            at = at.join(e, F.col("node") == F.col("e_src")).select("origin", F.col("e_dst").alias("node")).repartition(n, "node").distinct()
            met = at.withColumn("hop", F.lit(hop))
            found = met if found is None else found.unionByName(met)
        found = found.repartition(n, "node").groupBy("origin", "node").agg(F.min("hop").alias("hop"))
        if rounds:
            # an anti join would be pushed down into each step, which then is no more the one that others share
            known = seen.read().select("origin", "node", F.lit(True).alias("known"))
            found = found.join(shuffled(known), ["origin", "node"], "left").where("known IS NULL")
        seen.append(found.select("origin", "node", (F.col("hop") == STRIDE).alias("last"), F.lit(rounds).alias("round")), at_once=True)
        new = seen.read().where((F.col("round") == rounds) & F.col("last")).select("origin", "node")
        if new.isEmpty():
            return seen.closed().select("origin", "node")
        rounds += 1


def reversed_edges(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def dependent_counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """How many nodes depend on each, directly or not."""
    n = closure(edges).groupBy("node").agg(F.count("*").alias("dependents"))
    return nodes.select("node").join(shuffled(n), "node", "left").select("node", F.coalesce("dependents", F.lit(0)).alias("dependents"))


def direct_dependents(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    n = edges.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("direct"))
    return nodes.select("node").join(n, "node", "left").select("node", F.coalesce("direct", F.lit(0)).alias("direct"))


def longest_paths(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Per node its own cost plus the costliest chain of dependents above it (critical path), for acyclic edges.

    Values spread along jumps of 1, 2, 4 and more steps, so that a long chain
    takes few rounds. A round writes only the nodes whose value rose, with
    their new value; the largest of a node's values is its own.
    """
    e = edges.join(shuffled(nodes.select(F.col("node").alias("dst"), F.col("cost").alias("_cost"))), "dst")
    e = jumps(e, "_cost").select(F.col("src").alias("e_src"), F.col("dst").alias("e_dst"), F.col("gain").alias("_cost"))
    new = checkpointed(nodes.select("node", F.col("cost").alias("path")))
    best = new
    while not new.isEmpty():
        up = new.join(shuffled(e), new["node"] == e["e_src"]).groupBy(F.col("e_dst").alias("node")).agg(F.max(F.col("path") + F.col("_cost")).alias("path"))
        # of a node's values so far only the largest counts
        known = best.groupBy("node").agg(F.max("path").alias("known"))
        new = checkpointed(up.join(shuffled(known), "node").where(F.col("path") > F.col("known")).select("node", "path"))
        best = best.unionByName(new)
    return nodes.select("node", "cost").join(shuffled(best.groupBy("node").agg(F.max("path").alias("path"))), "node")


def depths(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Steps of the longest chain of dependents above each node."""
    steps = longest_paths(nodes.select("node", F.lit(1).cast("long").alias("cost")), edges)
    return steps.select("node", (F.col("path") - 1).alias("depth"))


def merged_priority(nodes: DataFrame, weights: DataFrame, baseline: DataFrame) -> DataFrame:
    """(weight - min(0, least weight) + 1) * 2**20 + baseline; no weight leaves the baseline."""
    low = weights.agg(F.least(F.lit(0), F.min("weight")).alias("low"))
    j = nodes.select("node").join(weights, "node", "left").join(baseline, "node", "left").crossJoin(F.broadcast(low))
    base = F.coalesce("base", F.lit(0))
    return j.select("node", F.when(F.col("weight").isNull(), base).otherwise((F.col("weight") - F.col("low") + 1) * (1 << 20) + base).alias("priority"))


def affected(seeds: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, hops, via): seeds with 0 hops, and all that depend on them by the fewest; via is the least node on the way."""
    e = edges.select(F.col("src").alias("e_src"), F.col("dst").alias("e_dst"))
    new = checkpointed(seeds.select("node").distinct().select("node", F.lit(0).alias("hops"), F.lit(None).cast("long").alias("via")))
    seen, hops = new, 0
    while not new.isEmpty():
        hops += 1
        step = new.join(shuffled(e), new["node"] == e["e_dst"]).groupBy(F.col("e_src").alias("node")).agg(F.min("node").alias("via"))
        step = step.join(shuffled(seen.select("node")), "node", "left_anti")
        new = checkpointed(step.select("node", F.lit(hops).alias("hops"), "via"))
        seen = seen.unionByName(new)
    return seen


def tainted(roots: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, root): nodes that depend on a root, with the least such root; a root counts as its own."""
    e = edges.select(F.col("src").alias("e_src"), F.col("dst").alias("e_dst"))
    best = checkpointed(roots.select("node", F.col("node").alias("root")).distinct())
    changed = best
    while not changed.isEmpty():
        up = changed.join(shuffled(e), changed["node"] == e["e_dst"]).groupBy(F.col("e_src").alias("node")).agg(F.min("root").alias("up"))
        both = checkpointed(best.join(shuffled(up), "node", "full").select("node", F.col("root").alias("old"), F.least("root", "up").alias("root")))
        changed = both.where(F.col("old").isNull() | (F.col("root") < F.col("old"))).select("node", "root")
        best = both.select("node", "root")
    return best


def restricted_closure(edges: DataFrame, through: DataFrame, seeds: DataFrame) -> DataFrame:
    """What seeds reach on paths whose inner nodes all belong to `through`.

    A seed outside `through` starts paths of its own, and ends those of the others.
    """
    marked = _marked(edges, through)
    inner = checkpointed(marked.join(shuffled(through.select(F.col("node").alias("src"))), "src", "left_semi"))
    first = marked.join(shuffled(seeds.select(F.col("node").alias("src"))), "src", "left_semi")
    if not shallow(inner):
        return reached(first, inner)
    # what lies outside `through` is carried no further
    last = (~F.col("within")).alias("last")
    return _pairs(_ways(first.select("src", "dst", last), inner.select("src", "dst", last)))


def nearest_holders(edges: DataFrame, holders: DataFrame, seeds: DataFrame) -> DataFrame:
    """(origin, node): the first holders on each way down from a seed; a way ends at its holder."""
    held = holders.select("node").distinct()
    marked = _marked(edges, held)
    # steps go on from what holds nothing, from a seed whatever it holds
    open_ = checkpointed(marked.join(shuffled(held.select(F.col("node").alias("src"))), "src", "left_anti"))
    first = marked.join(shuffled(seeds.select(F.col("node").alias("src"))), "src", "left_semi")
    if not shallow(open_):
        return checkpointed(reached(first, open_)).join(shuffled(held), "node", "left_semi").select("origin", "node")
    # the mark tells the holders: a join after the walk would be done once for each round
    last = F.col("within").alias("last")
    return _pairs(_ways(first.select("src", "dst", last), open_.select("src", "dst", last)).where("last"))


def cyclic(edges: DataFrame) -> DataFrame:
    """Edges that a peel of nodes without dependents leaves over: the cycles and what they depend on."""
    left = checkpointed(edges.select("src", "dst").distinct())
    n = left.count()
    while n:
        for _ in range(3):  # three peels a round
            left = left.join(shuffled(left.select(F.col("dst").alias("src")).distinct()), "src", "left_semi")
        left = checkpointed(left)
        m = left.count()
        if m == n:
            break
        n = m
    return left


def owner_of(paths: DataFrame, projects: DataFrame) -> DataFrame:
    """The project with the longest directory at or above each path, by an equal join on the path's ancestors.

    No side is broadcast: there may be as many projects as paths. Paths are
    dealt over the tasks before each becomes as many rows as it has ancestors.
    """
    parts = F.split("path", "/")
    up = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    a = paths.repartition("path").select("path", F.explode(up).alias("dir"))
    hits = a.join(shuffled(projects.select("dir", "name")), "dir").groupBy("path").agg(F.max_by("name", F.length("dir")).alias("owner"))
    return paths.join(shuffled(hits), "path", "left").select("path", "owner")


def nested_dirs(projects: DataFrame) -> DataFrame:
    """(outer, inner) of directories that lie in one another; `foo` doesn't hold `foo-utils`."""
    parts = F.split("dir", "/")
    up = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    inner = projects.select(F.col("dir").alias("inner"), F.explode(up).alias("outer")).where("inner <> outer")
    return inner.join(projects.select(F.col("dir").alias("outer")), "outer", "left_semi").select("outer", "inner")


def _peeled(edges: DataFrame) -> DataFrame:
    """Edges without some of those that lie on no cycle: what leads to a node without dependencies or from one without dependents."""
    for _ in range(2):
        ends = shuffled(edges.select(F.col("src").alias("dst")).distinct()), shuffled(edges.select(F.col("dst").alias("src")).distinct())
        edges = checkpointed(edges.join(ends[0], "dst", "left_semi").join(ends[1], "src", "left_semi").select("src", "dst"))
    return edges


#: Rounds along single edges before longer jumps are made: most graphs need fewer.
SINGLE = 24


def _least(edges: DataFrame) -> DataFrame:
    """(node, down, up): the least node that each end of edges reaches, and the least that reaches it, itself included."""
    # what `at` knows, `to` learns
    both_ways = lambda e: e.select(F.lit(False).alias("up"), F.col("dst").alias("at"), F.col("src").alias("to")).unionByName(e.select(F.lit(True).alias("up"), F.col("src").alias("at"), F.col("dst").alias("to")))
    steps, rounds = both_ways(edges), 0
    ends = edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    best = checkpointed(ends.select("node", F.explode(F.array(F.lit(False), F.lit(True))).alias("up"), F.col("node").alias("least")))
    changed = best
    while not changed.isEmpty():
        rounds += 1
        if rounds == SINGLE:
            steps = both_ways(jumps(edges))
        told = changed.withColumnRenamed("node", "at").join(shuffled(steps), ["at", "up"]).groupBy(F.col("to").alias("node"), "up").agg(F.min("least").alias("told"))
        both = checkpointed(best.join(shuffled(told), ["node", "up"], "left").select("node", "up", F.col("least").alias("old"), F.least("least", "told").alias("least")))
        changed = both.where("least < old").select("node", "up", "least")
        best = both.select("node", "up", "least")
    return best.groupBy("node").agg(F.min(F.when(~F.col("up"), F.col("least"))).alias("down"), F.min(F.when(F.col("up"), F.col("least"))).alias("up"))


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, component): strongly connected components by their least node; a node on no cycle is its own.

    Nodes, whole numbers, are told by a hash that is one to one, so that the
    least is any of them. Each round finds the least node that every node
    reaches and the least that reaches it. Where both are one, that is the
    node's component; edges between nodes that differ in either lie on no
    cycle and are dropped. Of c cycles on one path about the logarithm of c
    rounds are expected, whatever the order of the ids.
    """
    # of one long, xxhash64 is a chain of steps that can be undone
    hashed = lambda c: F.xxhash64(F.col(c).cast("long"))
    e = edges.where("src <> dst")
    left = _peeled(checkpointed(e.select(hashed("src").alias("src"), hashed("dst").alias("dst")).distinct()))
    found = []
    while not left.isEmpty():
        least = checkpointed(_least(left))
        found.append(least.where("down = up").select("node", F.col("down").alias("component")))
        of = lambda end: shuffled(least.where("down <> up").select(F.col("node").alias(end), F.struct("down", "up").alias(f"{end}_of")))  # noqa: E731, B023
        left = _peeled(checkpointed(left.join(of("src"), "src").join(of("dst"), "dst").where("src_of = dst_of").select("src", "dst")))
    if not found:
        return nodes.select("node", F.col("node").alias("component"))
    every = found[0]
    for part in found[1:]:
        every = every.unionByName(part)
    ids = e.select(F.explode(F.array("src", "dst")).alias("id")).distinct().withColumn("node", hashed("id"))
    every = checkpointed(ids.join(shuffled(every), "node").select("id", F.col("component").alias("by")))
    named = every.join(shuffled(every.groupBy("by").agg(F.min("id").alias("component"))), "by").select(F.col("id").alias("node"), "component")
    return nodes.select("node").join(shuffled(named), "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def _as_set(digest) -> list:
    """Aggregates that fold hex digests whatever their order: sums of their four parts, combined before a shuffle."""
    part = lambda i: F.conv(F.substring(digest, 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)")
    return [F.sum(part(i)).alias(f"_h{i}") for i in range(4)]


def _folded(n: str):
    return F.sha2(F.concat_ws(":", F.coalesce(n, F.lit(0)), *(F.coalesce(F.col(f"_h{i}"), F.lit(0)) for i in range(4))), 256)


def reach_digests(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, digest) over everything that a node (node, name) reaches; what lies elsewhere doesn't move it.

    Members of a cycle share one digest. A component folds its members, each
    as its name and the names its edges lead to, then the digests of the
    components below it, both whatever their order. Components go bottom up
    by level, and each hands its digest to the level that needs it next:
    every row is written and read once.
    """
    spark = nodes.sparkSession
    e = checkpointed(edges.select("src", "dst").where("src <> dst").distinct())
    comp = checkpointed(components(nodes, e))
    of = lambda end: comp.select(F.col("node").alias(end), F.col("component").alias(f"{end}_c"))
    up = checkpointed(e.join(shuffled(of("src")), "src").join(shuffled(of("dst")), "dst").where("src_c <> dst_c").select(F.col("src_c").alias("src"), F.col("dst_c").alias("dst")).distinct())

    names = e.join(nodes.select(F.col("node").alias("dst"), F.sha2(F.coalesce("name", F.lit("")), 256).alias("to")), "dst").select("src", "to").distinct()
    lands = names.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("_n"), *_as_set("to"))
    line = nodes.select("node", "name").join(lands, "node", "left").select("node", F.sha2(F.concat_ws("\0", F.coalesce("name", F.lit("")), _folded("_n")), 256).alias("line"))
    own = comp.join(line, "node").groupBy(F.col("component").alias("node")).agg(F.count("*").alias("_n"), *_as_set("line")).select("node", _folded("_n").alias("own"))

    ids = comp.select(F.col("component").alias("node")).distinct()
    level = checkpointed(longest_paths(ids.withColumn("cost", F.lit(1).cast("long")), reversed_edges(up)).select("node", (F.col("path") - 1).alias("level")))
    own_at, kids_at = shared_folder(spark), shared_folder(spark)
    own = own.join(level, "node")
    own.write.partitionBy("level").parquet(own_at)
    above = checkpointed(up.join(level.select(F.col("node").alias("src"), "level"), "src").select("src", "dst", "level"))
    handed = "src {0}, digest string, level long".format(up.schema["src"].dataType.simpleString())
    top = level.agg(F.max("level")).first()[0]
    done = []
    for k in range((-1 if top is None else top) + 1):
        now = spark.read.schema(own.schema).parquet(own_at).where(F.col("level") == k)
        if k:
            kids = spark.read.schema(handed).parquet(kids_at).where(F.col("level") == k).select("src", "digest").distinct()
            kids = kids.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("_n"), *_as_set("digest")).select("node", _folded("_n").alias("kids"))
            now = now.join(kids, "node", "left")
        else:
            now = now.withColumn("kids", F.lit(None).cast("string"))
        now = checkpointed(now.select("node", F.sha2(F.concat("own", F.coalesce("kids", F.lit(""))), 256).alias("digest")))
        done.append(now)
        if k < top:
            above.join(now.select(F.col("node").alias("dst"), "digest"), "dst").select("src", "digest", "level").write.mode("append").partitionBy("level").parquet(kids_at)
    if not done:
        return nodes.select("node", F.lit("").alias("digest"))
    every = done[0]
    for part in done[1:]:
        every = every.unionByName(part)
    return comp.join(shuffled(every.withColumnRenamed("node", "component")), "component").select("node", "digest")


def chain(paths: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: the length of the longest chain and the whole work of (node, cost, path)."""
    return paths.agg(F.max("path").alias("longest"), F.sum("cost").alias("work"), F.count(F.when(F.col("cost") == 0, 1)).alias("unknown"))


def ranked_by_path(paths: DataFrame, k: int) -> DataFrame:
    n = F.row_number().over(Window.orderBy(F.desc("path"), "node"))
    return paths.orderBy(F.desc("path"), "node").limit(k).withColumn("place", n)
