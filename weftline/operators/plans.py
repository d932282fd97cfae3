"""What a task graph predicts: levels, chains, what is left of a run, root causes, loops and likely misses.

src depends on dst in all edges, as in graph.py.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.specs import brace_alternatives
from ..sources.shared import shared_folder, shuffled, written
from . import graph as G
from .selectors import _ancestors, _path_like


def settled(nodes: DataFrame, edges: DataFrame, own: Column, head: Column) -> DataFrame:
    """(node, end, start, via, head, first, level): per node what the costliest chain of its dependencies ends in.

    end is start, the largest end of the dependencies (0 for none), and own.
    via is the dependency it comes from, the least of equals; first the least
    dependency at all. head(node) is kept where it isn't null, else via's is
    taken on. A node is settled once, when its last dependency is: a round
    reads the edges of the nodes that it settles, and no others. Nodes on a
    cycle and those above one never settle and have no row.
    """
    spark = nodes.sparkSession
    n = nodes.select("node", own.alias("own"), head.alias("_head"))
    e = written(edges.select("src", "dst").distinct())
    need = e.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("need"))
    waiting = written(n.join(shuffled(need), "node", "left").withColumn("need", F.coalesce("need", F.lit(0))))
    root, k, done = shared_folder(spark), 0, []
    # what the dependencies that are settled have said so far, one row for each node that is told
    told = None
    while True:
        if told is None:
            now = waiting.where("need = 0").select("node", "own", "_head", F.lit(None).cast("struct<less:double,via:bigint,head:bigint>").alias("best"), F.lit(None).cast("bigint").alias("first"))
        else:
            now = told.where("got = need").select("node", "own", "_head", "best", "first")
        start = F.coalesce(-F.col("best.less"), F.lit(0.0))
        now = now.select("node", (start + F.col("own")).alias("end"), start.alias("start"), F.col("best.via").alias("via"), F.coalesce("_head", "best.head").alias("head"), "first", F.lit(k).alias("level"))
        now.write.parquet(f"{root}/level-{k}")
        now = spark.read.schema(now.schema).parquet(f"{root}/level-{k}")
        if now.isEmpty():
            break
        done.append(f"{root}/level-{k}")
        k += 1
        said = now.join(shuffled(e.withColumnRenamed("dst", "node")), "node").select(F.col("src").alias("to"), F.struct((-F.col("end")).alias("less"), F.col("node").cast("bigint").alias("via"), F.col("head").cast("bigint").alias("head")).alias("best"), F.col("node").cast("bigint").alias("first"), F.lit(1).cast("bigint").alias("got"))
        if told is not None:
            said = said.unionByName(told.where("got < need").select(F.col("node").alias("to"), "best", "first", "got"))
        said = said.groupBy(F.col("to").alias("node")).agg(F.min("best").alias("best"), F.min("first").alias("first"), F.sum("got").alias("got"))
        told = written(said.join(shuffled(waiting), "node"))
    schema = now.schema
    return spark.read.schema(schema).parquet(*done) if done else now


def followed(start: DataFrame, pointers: DataFrame, *keys: str) -> DataFrame:
    """(keys, node, steps): start's (keys, node) and all that pointers (keys, node, next) lead to from them.

    Pointers are doubled, so a way of n steps takes about log2(n) rounds.
    """
    way = written(start.select(*keys, "node", F.lit(0).cast("long").alias("steps")))
    jump, far = written(pointers.where("next IS NOT NULL").select(*keys, "node", "next")), 1
    while not jump.isEmpty():
        way = written(way.unionByName(way.join(shuffled(jump), [*keys, "node"]).select(*keys, F.col("next").alias("node"), (F.col("steps") + far).alias("steps"))))
        onward = jump.select(*keys, F.col("node").alias("next"), F.col("next").alias("_next"))
        jump = written(jump.join(shuffled(onward), [*keys, "next"]).select(*keys, "node", F.col("_next").alias("next")))
        far *= 2
    return way


def predicted_chain(tasks: DataFrame, edges: DataFrame) -> DataFrame:
    """(place, node, cost): the longest chain of predicted cost, first task first, without tasks that cost nothing.

    tasks: (node, cost), cost 0 for hits and groups and for tasks without a
    history. The chain ends in the task whose end is largest, the least of equals.
    """
    s = settled(tasks, edges, F.coalesce(F.col("cost").cast("double"), F.lit(0.0)), F.lit(None).cast("long"))
    # a dependency that ends at 0 carries nothing: the way stops before it
    s = written(s.select("node", "end", F.when(F.col("start") > 0, F.col("via")).alias("next")))
    last = s.orderBy(F.desc("end"), "node").limit(1).select("node")
    way = followed(last, s.select("node", "next")).join(shuffled(tasks.select("node", "cost")), "node").where("cost > 0")
    # at most the levels of the graph: one chain
    n = way.agg(F.max("steps")).first()[0]
    return way.select((F.lit(-1 if n is None else n) - F.col("steps")).alias("place"), "node", "cost")


def live_forecast(tasks: DataFrame, edges: DataFrame, now: int, workers: int) -> tuple[DataFrame, DataFrame]:
    """What is left of a run: one row (eta_ms, critical, waiting), and the blocked tasks (place, node, by).

    tasks: (node, p50, state, since, is_group, rank), state being finished,
    running or null. A task to run costs its p50, a running one what is left
    of it, a group or one without p50 nothing. eta is the later of the longest
    unfinished chain and the work spread over the workers; null if no p50 is
    known. A waiting task is blocked by the running task that its costliest
    chain waits on, else by its least unfinished dependency. The `workers`
    blocked tasks of the highest rank are returned, equals by node.
    """
    live = written(tasks.where("state IS NULL OR state <> 'finished'"))
    ids = live.select(F.col("node").alias("src"))
    e = edges.join(shuffled(ids), "src", "left_semi").join(shuffled(ids.withColumnRenamed("src", "dst")), "dst", "left_semi")
    known = F.when(F.col("is_group"), None).otherwise(F.col("p50"))
    own = F.coalesce(F.when(F.col("state") == "running", F.greatest(F.lit(0), known - (F.lit(now) - F.col("since")))).otherwise(known).cast("double"), F.lit(0.0))
    s = settled(live, e, own, F.when(F.col("state") == "running", F.col("node")).cast("long"))
    j = written(s.join(shuffled(live.select("node", "state", "is_group", "rank", own.alias("own"), known.isNotNull().alias("known"))), "node"))
    by = F.coalesce("head", "first")
    held = j.where((F.coalesce("state", F.lit("")) != "running") & ~F.col("is_group") & by.isNotNull()).select("node", by.alias("by"), "rank")
    waiting = held.agg(F.count("*").alias("waiting"))
    total = j.agg(F.max("end").alias("chain"), F.sum("own").alias("work"), F.max("known").alias("known"), F.min(F.struct((-F.col("end")).alias("less"), F.col("node"), F.col("head"))).alias("last"))
    # one row each
    eta = F.when(F.col("known"), F.greatest("chain", F.col("work") / max(workers, 1)))
    out = total.crossJoin(F.broadcast(waiting)).select(eta.alias("eta_ms"), F.when(F.col("known"), F.col("last.head")).alias("critical"), "waiting")
    few = held.orderBy(F.desc("rank"), "node").limit(workers)
    from pyspark.sql import Window

    return out, few.select(F.row_number().over(Window.orderBy(F.desc("rank"), "node")).cast("long").alias("place"), "node", "by")


def root_causes(asked: DataFrame, moved: DataFrame, own: DataFrame) -> DataFrame:
    """(asked, root, place, node): per asked task the tasks below it whose own parts moved, each with the chain to it.

    moved: (src, dst) upstream parts that moved, groups to their members
    included; own: (node) whose own parts moved. A walk in the order of the
    tasks that visits each once comes to a root by the way that is first in
    that order: at each step the least task from which the root can be
    reached. So every step follows from what reaches what, and all tasks that
    are asked walk at once. An asked task's own parts are no cause of it.
    """
    back = G.reversed_edges(moved)
    reach = G.reached(own.join(back.withColumnRenamed("src", "node"), "node").select(F.col("node").alias("src"), "dst"), back).select(F.col("origin").alias("root"), "node")
    # (root, node, next): the step from each node that reaches a root, other than from the root on
    ends = reach.select("root", F.col("node").alias("dst")).unionByName(own.select(F.col("node").alias("root"), F.col("node").alias("dst"))).distinct()
    step = written(moved.join(ends, "dst").groupBy("root", F.col("src").alias("node")).agg(F.min("dst").alias("next")).where("root <> node"))
    pairs = reach.join(asked.select("node"), "node", "left_semi").where("root <> node").select(F.col("node").alias("asked"), "root", "node")
    rounds, out = written(pairs.withColumn("place", F.lit(0))), None
    while not rounds.isEmpty():
        out = rounds if out is None else out.unionByName(rounds)
        rounds = written(rounds.join(step, ["root", "node"]).select("asked", "root", F.col("next").alias("node"), (F.col("place") + 1).alias("place")))
    return (rounds if out is None else out).select("asked", "root", "place", "node")


def named_loops(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(component, place, node): for each strongly connected component one concrete loop, from its least node back to it.

    The shortest such loop, the least way of equals; place 0 is the least
    node. A task that depends on itself is a loop of one.
    """
    comp = written(G.components(nodes, edges))
    of = lambda end: comp.select(F.col("node").alias(end), F.col("component").alias(f"{end}_c"))
    inner = written(edges.join(shuffled(of("src")), "src").join(shuffled(of("dst")), "dst").where("src_c = dst_c").select(F.col("src_c").alias("component"), "src", "dst").distinct())
    new = written(inner.where("src = component").select("component", F.col("dst").alias("node"), F.col("src").alias("via")).distinct().withColumn("hops", F.lit(1)))
    seen, hops = new, 1
    while not new.isEmpty():
        hops += 1
        # a loop that has closed ends its component's search
        closed = seen.where("node = component").select("component")
        step = new.join(shuffled(closed), "component", "left_anti").withColumnRenamed("node", "src").drop("via", "hops").join(shuffled(inner), ["component", "src"])
        step = step.groupBy("component", F.col("dst").alias("node")).agg(F.min("src").alias("via")).withColumn("hops", F.lit(hops))
        new = written(step.join(shuffled(seen.select("component", "node")), ["component", "node"], "left_anti"))
        seen = seen.unionByName(new)
    seen = written(seen)
    ends = seen.where("node = component")
    # back from the closing step to the least node; the loop's last step isn't a step on the way
    ways = followed(ends.select("component", F.col("via").alias("node")), seen.where("node <> component").select("component", "node", F.col("via").alias("next")), "component")
    return ways.join(ends.select("component", F.col("hops").alias("n")), "component").select("component", (F.col("n") - 1 - F.col("steps")).cast("long").alias("place"), "node")


#: The files at the root that every key reads, the configuration folder among them.
WHOLE = r"^(?:\.workspace/|(?:bun\.lockb?|pnpm-lock\.yaml|package-lock\.json|yarn\.lock)$)"


def likely_misses(tasks: DataFrame, inputs: DataFrame, changed: DataFrame, edges: DataFrame, config: str = r"^(?:package\.json|workspace\.config\.[cm]?[jt]s)$") -> DataFrame:
    """(node): the cached tasks that changed paths make miss: by their inputs, their project's manifest, or a task below.

    tasks: (node, dir, cached); inputs: (node, scope, pattern), scope being
    project (below the task's directory) or workspace; changed: (path). A
    pattern without a special character names a file or its tree; one with `!`
    leaves out and is passed over, so that the guess leans to a miss. A changed
    file at the root that all keys read is every task's that has inputs. Many
    patterns meet many paths by the directory before the first special
    character, not pair by pair.
    """
    have = tasks.join(shuffled(inputs.select("node").distinct()), "node", "left_semi")
    p = inputs.where(~F.startswith("pattern", F.lit("!"))).join(shuffled(tasks.select("node", "dir")), "node")
    rel = F.regexp_replace(F.regexp_replace("pattern", r"^\./", ""), "/$", "")
    whole = F.when((F.col("scope") == "project") & (F.col("dir") != ""), F.concat("dir", F.lit("/"), rel)).otherwise(rel)
    p = p.select("node", F.explode(brace_alternatives(whole)).alias("pattern")).withColumn("special", F.regexp_like("pattern", F.lit(r"[*?\[{]")))
    p = p.withColumn("at", F.when(F.col("special"), F.regexp_replace(F.regexp_extract("pattern", r"^([^*?\[{]*/)?", 1), "/$", "")).otherwise(F.col("pattern")))
    c = changed.select("path", F.explode(F.array_union(_ancestors(F.col("path")), F.array("path"))).alias("at"))
    hit = p.join(shuffled(c), "at").where(~F.col("special") | F.rlike("path", _path_like(F.col("pattern")))).select("node")
    last = F.element_at(F.split("path", "/"), -1)
    manifests = changed.where(F.regexp_like(last, F.lit(config))).select(F.regexp_replace(F.left("path", F.length("path") - F.length(last)), "/$", "").alias("dir")).distinct()
    own = hit.unionByName(have.join(shuffled(manifests), "dir").select("node"))
    # one row if any path is every key's
    all_ = changed.where(F.regexp_like("path", F.lit(WHOLE))).limit(1).select(F.lit(True).alias("_"))
    own = own.unionByName(have.withColumn("_", F.lit(True)).join(all_, "_").select("node"))
    return G.affected(own.distinct(), edges).select("node").join(shuffled(tasks.where("cached").select("node")), "node", "left_semi")


def importer_digests(nodes: DataFrame, edges: DataFrame, importers: DataFrame, variants: DataFrame, shared: str = "") -> DataFrame:
    """(node, digest) of each importer over all that it reaches, variants of one package reaching one another.

    variants: (variant, node). The nodes of a variant meet in a hub, a node of
    its own that they lead to and that leads to them: two edges a node instead
    of one a pair. shared is what every digest holds besides.
    """
    many = variants.groupBy("variant").agg(F.count("*").alias("n")).where("n > 1").select("variant")
    hubs = variants.join(many, "variant").select("variant", "node")
    ids = hubs.select("variant").distinct().select("variant", (-F.xxhash64("variant").bitwiseAND(F.lit((1 << 62) - 1)) - 1).alias("hub"))
    legs = written(hubs.join(ids, "variant").select(F.col("node").cast("long").alias("node"), "hub"))
    n = nodes.select(F.col("node").cast("long").alias("node"), "name").unionByName(ids.select(F.col("hub").alias("node"), F.concat(F.lit("variants\0"), F.col("variant")).alias("name")))
    e = edges.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst")).unionByName(legs.select(F.col("node").alias("src"), F.col("hub").alias("dst"))).unionByName(legs.select(F.col("hub").alias("src"), F.col("node").alias("dst")))
    d = G.reach_digests(n, e).join(importers.select(F.col("node").cast("long").alias("node")), "node", "left_semi")
    return d.select("node", F.sha2(F.concat(F.lit(shared), F.lit("\0"), "digest"), 256).alias("digest"))
