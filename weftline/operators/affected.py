"""Which asked tasks a change reaches, and why: changed paths to tasks by their inputs, then along task edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.specs import brace_alternatives
from ..sources.shared import shuffled, written
from . import graph as G
from .selectors import _ancestors, _path_like


def declared(tasks: DataFrame, inputs: DataFrame, changed: DataFrame) -> DataFrame:
    """(node, scope, path): the changed paths that are inputs of a task, less those that a pattern with `!` leaves out.

    tasks: (node, dir); inputs: (node, scope, pattern), scope being project
    (below the task's directory) or workspace; changed: (path). A pattern
    without a special character names a file or its tree. Patterns meet paths
    by an equal join on the directory before the first special character.
    """
    p = inputs.join(shuffled(tasks.select("node", "dir")), "node").withColumn("out", F.startswith("pattern", F.lit("!")))
    rel = F.regexp_replace(F.regexp_replace("pattern", r"^!?(?:\./)?", ""), "/$", "")
    p = p.withColumn("pattern", F.when((F.col("scope") == "project") & (F.col("dir") != ""), F.concat("dir", F.lit("/"), rel)).otherwise(rel))
    p = p.select("node", "scope", "out", F.explode(brace_alternatives(F.col("pattern"))).alias("pattern")).withColumn("special", F.regexp_like("pattern", F.lit(r"[*?\[]")))
    p = p.withColumn("at", F.when(F.col("special"), F.regexp_replace(F.regexp_extract("pattern", r"^([^*?\[]*/)?", 1), "/$", "")).otherwise(F.col("pattern")))
    c = changed.select("path", F.explode(F.array_union(_ancestors(F.col("path")), F.array("path"))).alias("at"))
    hit = p.join(shuffled(c), "at").where(~F.col("special") | F.rlike("path", _path_like(F.col("pattern"))))
    return hit.groupBy("node", "scope", "path").agg(F.bool_or("out").alias("out")).where("NOT out").select("node", "scope", "path")


def passed_through(specs: DataFrame, tasks: DataFrame, packages: DataFrame) -> DataFrame:
    """(node, project): the packages that a task's dependency on `^name` passes on its way down to the holders of name.

    specs: (node, name); tasks: (node, project, task); packages: (src, dst) of
    projects. All names walk at once; tasks of one project that ask for one
    name walk once.
    """
    e = shuffled(written(packages.select(F.col("src").alias("e_src"), F.col("dst").alias("e_dst"))))
    holds = shuffled(written(tasks.select(F.col("project").alias("at"), F.col("task").alias("name")).distinct()))
    asked = specs.join(shuffled(tasks.select("node", "project")), "node").select("node", F.col("project").alias("origin"), "name").distinct()
    step = asked.select("origin", "name", F.col("origin").alias("at")).distinct()
    seen = None
    while True:
        step = step.join(e, step["at"] == e["e_src"]).select("origin", "name", F.col("e_dst").alias("at")).where("at <> origin").distinct()
        step = step.join(holds, ["at", "name"], "left_anti")
        new = written((step if seen is None else step.join(shuffled(seen), ["origin", "name", "at"], "left_anti")).select("origin", "name", "at"))
        seen = new if seen is None else seen.unionByName(new)
        if new.isEmpty():
            return asked.join(shuffled(seen), ["origin", "name"]).select("node", F.col("at").alias("project")).distinct()
        step = new


def affected_tasks(
    tasks: DataFrame, projects: DataFrame, inputs: DataFrame, changed: DataFrame, edges: DataFrame, specs: DataFrame, packages: DataFrame, asked: DataFrame,
    wide: str = r"^(?:workspace\.config\.[cm]?[jt]s|\.gitattributes)$", rules: str = ".gitattributes", configs: str = r"package\.json|project\.config\.[cm]?[jt]s",
) -> tuple[DataFrame, DataFrame]:
    """The asked tasks that a change reaches, each with its reason; and the step (node, next) each unseeded task takes to its seed.

    tasks: (node, project, task, grouped), grouped ones running nothing;
    projects: (project, dir); inputs as in `declared`; changed: (path); edges:
    (src, dst) of tasks, without cycles, in the order of dst; specs and
    packages as in `passed_through`; asked: (node, named, outright), named
    ones and those of a project selected outright staying whatever changed.
    Returns (node, kind, file, project, seed, next, hops).

    A path belongs to the project with the nearest directory above it. It
    reaches the whole project if it is its configuration (configs, a pattern
    of names), or if no running task there declares it; a path that matches
    wide reaches every project, one named rules those at or below its
    directory. A task is a seed, the first that holds giving its kind:
    input, by a path of the workspace; project or workspace, without inputs
    in a changed project (a group is none), or with inputs in a whole one;
    input, by a path of its project; package, by a changed project without
    tasks that one of its specs passes. The rest is reached along edges, by
    the least dependency that is reached itself. Of several paths the least
    is named. Paths of no project reach only what declares them.
    """
    changed = changed.where("path IS NOT NULL").distinct()
    # one row at most: the workspace's own file that reaches all
    every = changed.where(F.regexp_like("path", F.lit(wide))).agg(F.min("path").alias("file")).where("file IS NOT NULL")
    owner = G.owner_of(changed, projects.select("dir", F.col("project").alias("name"))).where("owner IS NOT NULL").select("path", F.col("owner").alias("project"))
    owned = written(owner.join(F.broadcast(every), F.lit(True), "left_anti"))

    last = F.element_at(F.split("path", "/"), -1)
    below = changed.where(last == rules).select(F.col("path").alias("file"), F.regexp_replace(F.left("path", F.length("path") - F.length(last)), "/$", "").alias("at"))
    under = projects.select("project", F.explode(F.array_union(_ancestors(F.col("dir")), F.array("dir"))).alias("at")).join(shuffled(below), "at").select("project", "file")
    by = written(under.unionByName(projects.select("project").crossJoin(F.broadcast(every))).groupBy("project").agg(F.min("file").alias("by")))

    in_dir = tasks.join(shuffled(projects.select("project", "dir")), "project").select("node", "dir")
    hits = declared(in_dir, inputs, changed).join(shuffled(tasks.select("node", "project", "grouped")), "node")
    mine = owned.select("path", F.col("project").alias("holder"))
    hits = written(hits.join(shuffled(mine), "path", "left").where("scope = 'workspace' OR holder = project").select("node", "scope", "path", "grouped"))
    claimed = hits.where("scope = 'project' AND NOT grouped").select("path").distinct()
    config = owned.join(shuffled(projects), "project").where(F.rlike("path", F.concat(F.lit(r"^\Q"), "dir", F.lit(rf"\E/(?:{configs})$")))).select("project", "path")
    whole = owned.join(shuffled(claimed), "path", "left_anti").select("project", "path").unionByName(config).groupBy("project").agg(F.min("path").alias("whole"))

    least = lambda scope, name: hits.where(F.col("scope") == scope).groupBy("node").agg(F.min("path").alias(name))
    t = tasks.select("node", "project", "grouped").join(shuffled(inputs.select("node", F.lit(True).alias("keyed")).distinct()), "node", "left")
    t = t.join(shuffled(least("workspace", "far")), "node", "left").join(shuffled(least("project", "near")), "node", "left")
    t = t.join(shuffled(by), "project", "left").join(shuffled(whole), "project", "left").join(shuffled(owned.groupBy("project").agg(F.min("path").alias("first"))), "project", "left")
    loose = F.col("keyed").isNull() & ~F.col("grouped")
    kind = (
        F.when(F.col("far").isNotNull(), "input").when(loose & F.col("first").isNotNull(), "project").when((loose | F.col("keyed")) & F.col("by").isNotNull(), "workspace")
        .when(F.col("keyed") & F.col("whole").isNotNull(), "project").when(F.col("near").isNotNull(), "input")
    )
    file = F.when(F.col("far").isNotNull(), F.col("far")).when(loose & F.col("first").isNotNull(), F.col("first")).otherwise(F.coalesce("by", "whole", "near"))
    moved = owned.select("project").unionByName(by.select("project")).distinct().join(shuffled(tasks.select("project")), "project", "left_anti")
    through = passed_through(specs, tasks, packages).join(shuffled(moved), "project").groupBy("node").agg(F.min("project").alias("package"))
    t = t.withColumns({"kind": kind, "file": file}).join(shuffled(through), "node", "left")
    seeds = written(
        t.where("kind IS NOT NULL OR package IS NOT NULL")
        .select("node", F.coalesce("kind", F.lit("package")).alias("kind"), F.when(F.col("kind").isNotNull(), F.col("file")).alias("file"), F.when(F.col("kind").isNull(), F.col("package")).alias("project"))
    )

    reach = G.affected(seeds.select("node"), edges).select("node")
    later = reach.join(shuffled(seeds.select("node")), "node", "left_anti").withColumnRenamed("node", "src")
    steps = written(edges.join(shuffled(later), "src", "left_semi").join(shuffled(reach.withColumnRenamed("node", "dst")), "dst", "left_semi").groupBy(F.col("src").alias("node")).agg(F.min("dst").alias("next")))
    ends = seeds.select("node", F.col("node").alias("seed"), F.lit(0).cast("long").alias("hops")).unionByName(_ends(steps))
    why = ends.join(shuffled(seeds.withColumnRenamed("node", "seed")), "seed").join(shuffled(steps), "node", "left")
    kept = asked.join(shuffled(why), "node", "left").withColumn("own", F.when(F.col("named"), "named").when(F.col("outright"), "selected"))
    bare = lambda c: F.when(F.col("own").isNull(), F.col(c)).alias(c)
    kept = kept.where("own IS NOT NULL OR kind IS NOT NULL").select("node", F.coalesce("own", "kind").alias("kind"), *map(bare, ("file", "project", "seed", "next", "hops")))
    return kept, steps


def _ends(steps: DataFrame) -> DataFrame:
    """(node, seed, hops): where each node's steps end, by jumps that double: rounds are the logarithm of the longest way."""
    jump = written(steps.select("node", F.col("next").alias("seed"), F.lit(1).cast("long").alias("hops")))
    for _ in range(jump.count().bit_length() + 1):
        on = jump.select(F.col("node").alias("seed"), F.col("seed").alias("to"), F.col("hops").alias("more"))
        ahead = written(jump.join(shuffled(on), "seed", "left"))
        jump = ahead.select("node", F.coalesce("to", "seed").alias("seed"), (F.col("hops") + F.coalesce("more", F.lit(0))).alias("hops"))
        if ahead.where("to IS NOT NULL").isEmpty():
            break
    return jump


def chains(kept: DataFrame, steps: DataFrame) -> DataFrame:
    """(root, place, node): the way of each kept task to its seed, nearest first."""
    on = steps.select(F.col("node").alias("at"), F.col("next").alias("to"))
    new = written(kept.where("next IS NOT NULL").select(F.col("node").alias("root"), F.lit(1).cast("long").alias("place"), F.col("next").alias("node")))
    parts = new
    while not new.isEmpty():
        new = written(new.join(shuffled(on), new["node"] == on["at"]).select("root", (F.col("place") + 1).alias("place"), F.col("to").alias("node")))
        parts = parts.unionByName(new)
    return parts
