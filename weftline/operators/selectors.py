"""Project filters and task dependencies, compiled from rows of specs into joins and one walk for all of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.specs import brace_alternatives, dependency_spec, filter_spec
from ..functions.text import normal_path
from ..sources.shared import Buckets, shuffled, written
from . import graph as G

#: Characters of a pattern before its first star that join it to names: only names that begin so are tested.
HEAD = 4


def _like(pattern: Column) -> Column:
    """The regular expression of a pattern in which `*` alone is special."""
    quoted = F.concat(F.lit(r"\Q"), F.replace(pattern, F.lit("*"), F.lit(r"\E(?s:.*)\Q")), F.lit(r"\E"))
    return F.concat(F.lit("^"), quoted, F.lit("$"))


def _path_like(pattern: Column) -> Column:
    """The regular expression of a path glob: `*` and `?` stay in a part, `**` is any parts, none included, `[...]` one character."""
    steps = [(r"([\\.+^$(){}|])", r"\\$1"), (r"\[!", "[^"), (r"(^|/)\*\*/", "$1(?:[^/]+/)\x01"), (r"/\*\*$", "(?:/.\x01)?"), (r"^\*\*$", ".\x01"), (r"\*+", "[^/]\x01"), (r"\?(?!:)(?<!\)\?)", "[^/]"), ("\x01", "*")]
    for what, by in steps:
        pattern = F.regexp_replace(pattern, what, by)
    return F.concat(F.lit("^"), pattern, F.lit("$"))


def _ancestors(path: Column) -> Column:
    """The directories above a path, nearest last, the root as nothing."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(0), F.greatest(F.size(parts) - 1, F.lit(0))), lambda i: F.when(i == 0, "").otherwise(F.array_join(F.slice(parts, 1, F.greatest(i, F.lit(1))), "/")))


def _matching(asked: DataFrame, names: DataFrame) -> DataFrame:
    """(spec, node) of patterns (spec, pattern) over (node, name): by equal names, or by what comes before the first star."""
    exact = asked.where(~F.contains("pattern", F.lit("*"))).join(names.withColumnRenamed("name", "pattern"), "pattern").select("spec", "node")
    starred = asked.where(F.contains("pattern", F.lit("*"))).withColumn("head", F.left(F.substring_index("pattern", "*", 1), F.lit(HEAD)))
    heads = names.withColumn("head", F.explode(F.transform(F.sequence(F.lit(0), F.lit(HEAD)), lambda k: F.left("name", k)))).distinct()
    return exact.unionByName(starred.join(heads, "head").where(F.rlike("name", _like(F.col("pattern")))).select("spec", "node")).distinct()


def _on_paths(asked: DataFrame, dirs: DataFrame) -> DataFrame:
    """(spec, node, rank) of paths (spec, pattern) over (node, dir): 1 the directory itself, 2 below it, 3 as a glob."""
    itself = asked.join(dirs.withColumnRenamed("dir", "pattern"), "pattern").select("spec", "node", F.lit(1).alias("rank"))
    below = dirs.where("dir <> ''").select("node", F.explode(_ancestors(F.col("dir"))).alias("pattern"))
    under = asked.join(below, "pattern").select("spec", "node", F.lit(2).alias("rank"))
    # a glob is tested on what lies below the directories before its first special character
    glob = asked.where(F.regexp_like("pattern", F.lit(r"[*?\[{]"))).select("spec", F.explode(brace_alternatives(F.col("pattern"))).alias("pattern")).withColumn("head", F.regexp_replace(F.regexp_extract("pattern", r"^([^*?\[{]*/)?", 1), "/$", ""))
    root = dirs.where("dir = ''").select("node", F.lit("").alias("dir"), F.lit("").alias("head"))
    globbed = glob.join(dirs.where("dir <> ''").select("node", "dir", F.explode(F.array_union(_ancestors(F.col("dir")), F.array("dir"))).alias("head")).unionByName(root), "head")
    # of globs only ** reaches the root itself
    hits = globbed.where(F.rlike("dir", _path_like(F.col("pattern"))) & ((F.col("dir") != "") | (F.col("pattern") == "**")))
    return itself.unionByName(under).unionByName(hits.select("spec", "node", F.lit(3).alias("rank"))).distinct()


def _best(hits: DataFrame) -> DataFrame:
    """Of (spec, node, rank) the rows of each spec's least rank."""
    least = hits.groupBy("spec").agg(F.min("rank").alias("rank"))
    return hits.join(least, ["spec", "rank"], "left_semi").select("spec", "node").distinct()


def matched(specs: DataFrame, projects: DataFrame, upwards: tuple[DataFrame, int], changed: DataFrame) -> DataFrame:
    """(spec, node): what each parsed spec (spec, f) names before any walk along edges; upwards has them reversed.

    A name that none has is read as a path if it holds a slash outside a
    scope, else without the scopes of names: then a plain one must be the
    only such name. changed: (since, node).
    """
    dirs, f = projects.select("node", "dir"), specs.where("f.error IS NULL").select("spec", "f.*")
    named = f.where("kind = 'name'")
    whole = _matching(named.select("spec", F.col("matcher").alias("pattern")), projects.select("node", "name")).withColumn("rank", F.lit(0))
    as_path = named.where(F.contains("matcher", F.lit("/")) & ~F.startswith("matcher", F.lit("@")) & F.col("within").isNull()).select("spec", normal_path(F.col("matcher")).alias("pattern"))
    bare = named.where(~F.contains("matcher", F.lit("/"))).select("spec", F.col("matcher").alias("pattern"))
    tails = projects.where(F.startswith("name", F.lit("@"))).select("node", F.expr("substring(name, instr(name, '/') + 1)").alias("name"))
    # what is asked several times below is a table, else each step would do all those before it again
    tailed = written(_matching(bare, tails))
    single = tailed.groupBy("spec").agg(F.count("*").alias("n")).join(bare, "spec").where((F.col("n") == 1) | F.contains("pattern", F.lit("*"))).select("spec")
    hits = whole.unionByName(_on_paths(as_path, dirs)).unionByName(tailed.join(single, "spec", "left_semi").withColumn("rank", F.lit(4)))
    paths = _on_paths(f.where("kind = 'path'").select("spec", F.regexp_replace("matcher", "/+$", "").alias("pattern")), dirs)
    root = f.where("kind = 'root'").select("spec").join(dirs.where("dir = ''").select("node", F.lit(0).alias("rank"), F.lit("root").alias("kind")).join(f.where("kind = 'root'").select("spec", "kind"), "kind").select("spec", "node", "rank"), "spec")
    tags = projects.select("node", F.explode("tags").alias("name")).distinct()
    tagged = _matching(f.where("kind = 'tag'").select("spec", F.col("matcher").alias("pattern")), tags).withColumn("rank", F.lit(0))
    hits = _best(written(hits.unionByName(paths).unionByName(root.select("spec", "node", "rank")).unionByName(tagged)))

    narrowed = f.where("within IS NOT NULL").select("spec", F.col("within").alias("pattern"))
    inside, hits = _best(written(_on_paths(narrowed, dirs))), written(hits)
    hits = hits.join(narrowed.select("spec"), "spec", "left_anti").unionByName(hits.join(inside, ["spec", "node"], "left_semi"))

    ranged = f.where("since IS NOT NULL").select("spec", "kind", "since", "since_via_deps")
    moved = written(ranged.join(changed.select("since", "node"), "since").select("spec", "node", "kind", "since_via_deps"))
    wide = G.strides(moved.where("since_via_deps").select(F.col("spec").alias("origin"), "node"), upwards).select(F.col("origin").alias("spec"), "node")
    moved = moved.select("spec", "node").unionByName(wide).distinct()
    hits, moved = written(hits), written(moved)
    alone = moved.join(ranged.where("kind = 'changed'").select("spec"), "spec", "left_semi")
    both = hits.join(ranged.select("spec"), "spec", "left_anti").unionByName(hits.join(moved, ["spec", "node"], "left_semi")).unionByName(alone)
    return both.distinct()


def apply_filters(specs: DataFrame, projects: DataFrame, edges: DataFrame, changed: DataFrame) -> DataFrame:
    """(list, node): the projects that each list of filters (list, place, raw) selects.

    Every include comes before any exclude; a list without an include starts
    from all projects. A walk to both sides also takes the dependencies of the
    dependents. Filters in error select nothing (filter_errors() has them).
    """
    edges = written(edges.select("src", "dst").distinct())
    downwards, upwards = G.laid(edges), G.laid(G.reversed_edges(edges))
    parsed = written(specs.select("list", F.struct("list", "place").alias("spec"), filter_spec(F.col("raw")).alias("f")).where("f.error IS NULL"))
    hits = written(matched(parsed.select("spec", "f"), projects, upwards, changed))
    flags = parsed.select("spec", "f.negate", "f.with_deps", "f.with_dependents", "f.only_deps", "f.only_dependents")
    h = hits.join(flags, "spec")
    down, both = F.col("with_deps") | F.col("only_deps"), F.col("with_dependents") & (F.col("with_deps") | F.col("only_deps"))
    # what is reached upwards with `both` goes on upwards, and from there also down
    up = G.strides(h.where("with_dependents").select(F.struct("spec", both.alias("both")).alias("origin"), "node"), upwards).select("origin.spec", "origin.both", "node")
    turned = up.where("both").select(F.col("spec").alias("origin"), "node")
    below = G.strides(h.where(down).select(F.col("spec").alias("origin"), "node").unionByName(turned), downwards).select(F.col("origin").alias("spec"), "node")
    expanded = h.where("NOT only_deps AND NOT only_dependents").select("spec", "node").unionByName(up.select("spec", "node")).unionByName(below).distinct()
    e = expanded.join(flags.select("spec", "negate"), "spec").select(F.col("spec.list").alias("list"), "node", "negate")
    without = parsed.groupBy("list").agg(F.min("f.negate").alias("only_excludes")).where("only_excludes").select("list")
    # every project for a list of excludes alone: what those lists select
    every = projects.select("node", F.lit(True).alias("_")).join(without.withColumn("_", F.lit(True)), "_").select("list", "node")
    return e.where("NOT negate").select("list", "node").unionByName(every).distinct().join(e.where("negate").select("list", "node"), ["list", "node"], "left_anti")


def filter_errors(specs: DataFrame) -> DataFrame:
    """(list, place, raw, error) of the filters that can't be read."""
    return specs.withColumn("error", filter_spec(F.col("raw"))["error"]).where("error IS NOT NULL").select("list", "place", "raw", "error")


def resolve_dependencies(specs: DataFrame, tasks: DataFrame, edges: DataFrame, projects: DataFrame, each: bool = False) -> DataFrame:
    """(node, task, to_node, to_task): the task edges that entries (node, task, raw) stand for.

    tasks: (node, task). `^name` leads to the nearest dependencies that have
    such a task, through those that have none. A negated entry takes away
    what it stands for from the same task; entries in error stand for nothing.
    An edge comes once, with each once for every entry that stands for it.
    """
    p = written(specs.select("node", "task", "raw", dependency_spec(F.col("raw")).alias("d")).where("d.error IS NULL").select("node", "task", "raw", "d.kind", "d.project", F.col("d.task").alias("to"), "d.negated"))
    p = p.withColumn("pattern", F.coalesce("to", F.lit("*")))
    # the tasks of a project are one row, so nothing is joined by names, which most projects may share
    e, n = G.laid(edges)
    names = G.in_buckets(tasks.groupBy(F.col("node").alias("to_node")).agg(F.collect_set("task").alias("names")), "to_node", n)
    fits = lambda name: F.when(F.contains("pattern", F.lit("*")), F.rlike(name, _like(F.col("pattern")))).otherwise(F.col("pattern") == name)
    fitting = F.filter("names", fits)
    cols = ["node", "task", "raw", "negated", "to_node", "to_task"]
    own = p.where("kind IN ('self', 'wildcardSelf')").join(names, F.col("node") == F.col("to_node")).withColumn("to_task", F.explode(fitting))
    own = own.where(~((F.col("to_task") == F.col("task")) & F.contains("pattern", F.lit("*")))).select(cols)
    # what a project and a pattern name is found once, however many entries say so
    cross = p.where("kind = 'cross'")
    named = cross.select("project", "pattern").distinct().join(shuffled(projects.select(F.col("name").alias("project"), F.col("node").alias("at"))), "project")
    named = named.join(names, F.col("at") == F.col("to_node")).select("project", "pattern", "to_node", F.explode(fitting).alias("to_task"))
    cross = cross.join(shuffled(named), ["project", "pattern"]).select(cols)

    # one walk for all patterns: a way ends at the first project that holds a fitting task
    deps = p.where("kind IN ('deps', 'wildcardDeps')")
    new, rounds = deps.select(F.col("node").alias("origin"), "pattern", F.col("node").alias("at")).repartition(n, "at").distinct(), 0
    way = ["origin", "pattern", "at"]
    seen = Buckets(tasks.sparkSession, ["at"], n)
    while True:
        step = new.join(e, F.col("at") == F.col("e_src")).select("origin", "pattern", F.col("e_dst").alias("at")).repartition(n, "at").distinct()
        if rounds:
            step = step.join(shuffled(seen.read().select(*way, F.lit(True).alias("known"))), way, "left").where("known IS NULL")
        found = step.join(names, F.col("at") == F.col("to_node"), "left")
        seen.append(found.select(*way, F.coalesce(fitting, F.array()).alias("fitting"), F.lit(rounds).alias("round")), at_once=True)
        new = seen.read().where((F.col("round") == rounds) & (F.size("fitting") == 0)).select(way)
        if new.isEmpty():
            break
        rounds += 1
    nearest = seen.closed().where(F.size("fitting") > 0).select(F.col("origin").alias("node"), "pattern", F.col("at").alias("to_node"), "fitting")
    below = deps.join(shuffled(nearest), ["node", "pattern"]).withColumn("to_task", F.explode("fitting")).select(cols)
    every = own.unionByName(cross).unionByName(below)
    key = ["node", "task", "to_node", "to_task"]
    stated = every.where("NOT negated").select(*key, *(["raw"] if each else [])).distinct()
    return stated.join(shuffled(every.where("negated").select(key)), key, "left_anti").select(key)
