"""Which tasks' keys are known before anything runs.

A key is stable unless something that runs before the task may write where its
key reads. tasks are rows (task, project, dir, cached, inputs, ws_inputs,
outputs, ws_outputs, reach): glob lists relative to the project's directory, or
to the workspace for ws_; null inputs mean that the task has no key of its own.
reach tells what a command may write undeclared: 'none', 'project' or
'workspace'. edges are (src, dst), src after dst, without cycles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import shuffled, written
from . import graph as G


def literal_prefix(glob: str | Column) -> Column:
    """A glob's leading path segments without a wildcard; '' where its first has one."""
    g = F.col(glob) if isinstance(glob, str) else glob
    return F.when(~g.rlike(r"[*?{\[]"), F.rtrim(g, F.lit("/"))).otherwise(F.rtrim(F.regexp_extract(g, r"^([^*?{\[]*/)", 1), F.lit("/")))


def _at_or_above(path: Column) -> Column:
    """The path, the directories above it and '' for the root."""
    parts = F.split(path, "/")
    return F.when(path == "", F.array(F.lit(""))).otherwise(F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))))


def _meeting(readers: DataFrame, writers: DataFrame, by: list[str]) -> DataFrame:
    """Rows of both sides whose prefixes r and w are one another's ancestor, or equal: equal joins over ancestors, no pair is tried."""
    below = writers.withColumn("r", F.explode(_at_or_above(F.col("w"))))
    above = readers.withColumn("w", F.explode(_at_or_above(F.col("r")))).where("w <> r")
    cols = [*readers.columns, *(c for c in writers.columns if c not in readers.columns)]
    return readers.join(below, [*by, "r"]).select(*cols).unionByName(above.join(writers, [*by, "w"]).select(*cols))


def _entries(tasks: DataFrame, column: str, keep: list[str]) -> DataFrame:
    """One row a positive entry of a glob list."""
    return tasks.select(*keep, F.explode(column).alias("glob")).where(~F.col("glob").startswith("!")).distinct()


def producers_before(tasks: DataFrame, upwards: tuple[DataFrame, int]) -> DataFrame:
    """(task, project, kind): what may be written before a task, through any number of tasks between; upwards has the edges reversed.

    kind is 'declared' or 'wide' for writes in a project, 'workspace' (project
    '') for writes anywhere. Walks carry projects, not tasks.
    """
    some = lambda c: F.coalesce(F.size(c), F.lit(0)) > 0
    kinds = F.array_compact(F.array(
        F.when(some("outputs"), F.struct("project", F.lit("declared").alias("kind"))), F.when(F.col("reach") == "project", F.struct("project", F.lit("wide").alias("kind"))),
        F.when(some("ws_outputs") | (F.col("reach") == "workspace"), F.struct(F.lit("").alias("project"), F.lit("workspace").alias("kind"))),
    ))
    made = tasks.select(F.explode(kinds).alias("origin"), F.col("task").alias("node"))
    return G.strides(made, upwards).select(F.col("node").alias("task"), "origin.project", "origin.kind")


def classified(tasks: DataFrame, edges: DataFrame) -> DataFrame:
    """(task, stable, because): why a key waits is the first of 'same-project', 'workspace-output', 'workspace-input', 'upstream'.

    A declared output meets a task of its project only where the two globs'
    literal prefixes meet, and not where a `!` entry takes it back whole; nor
    where it writes into another task's tree. Not judged here: commands that
    rewrite their own inputs, probes, and what version control ignores. What
    has a row for each task is joined by shuffles. What has a row for each
    project or glob is a table first, so that its size is known: Spark takes
    it to be as large as what it was made of, or as small as that was on disk.
    """
    tasks = written(tasks)
    upwards = G.laid(G.reversed_edges(edges))
    before = written(producers_before(tasks, upwards))
    keyed = tasks.where("inputs IS NOT NULL")
    mine = keyed.select("task", "project").join(shuffled(before.where("project <> ''")), ["task", "project"]).select("task", "project", "kind").distinct()
    outputs = _entries(tasks, "outputs", ["project", F.col("task").alias("writer")]).withColumn("w", literal_prefix("glob"))
    outputs = written(outputs)
    with_outputs = written(outputs.select("project").distinct())
    bare = mine.join(with_outputs, "project", "left_anti")
    open_ = written(keyed.join(shuffled(mine.select("task").distinct()), "task", "left_semi"))

    reads = _entries(open_, "inputs", ["task", "project"]).select("task", "project", literal_prefix("glob").alias("r")).distinct()
    back = open_.select("task", F.filter("inputs", lambda g: g.startswith("!")).alias("back"))
    globs = written(outputs.select("project", F.col("glob").alias("output"), "w").distinct())
    met = _meeting(reads, globs, ["project"]).select("task", "output").distinct().join(shuffled(back), "task")
    taken = F.exists("back", lambda g: (g == F.concat(F.lit("!"), "output")) | (g.endswith("/**") & F.concat(F.lit("!"), "output").startswith(F.regexp_replace(g, r"\*\*$", ""))))
    met = met.where(~taken).select("task")
    writes = _entries(open_, "outputs", ["task", "project"]).select("task", "project", literal_prefix("glob").alias("r")).distinct()
    # another's tree is met where not all its writers are the task itself: two of them tell, pairs of writers aren't tried
    trees = written(outputs.groupBy("project", "w").agg(F.min("writer").alias("least"), F.max("writer").alias("most")))
    crossed = _meeting(writes, trees, ["project"]).where("least <> task OR most <> task").select("task")
    same = mine.where("kind = 'wide'").select("task").unionByName(bare.select("task")).unionByName(met).unionByName(crossed)

    anywhere = keyed.select("task").join(shuffled(before.where("kind = 'workspace'").select("task")), "task", "left_semi")

    wide = before.where("kind = 'wide'").select("task", "project").distinct()
    ws = keyed.where(F.size("ws_inputs") > 0)
    ws_reads = _entries(ws, "ws_inputs", ["task"]).select("task", literal_prefix("glob").alias("r")).distinct()
    dirs = written(tasks.groupBy("project").agg(F.min("dir").alias("dir")))
    rooted = outputs.select("project", "w").distinct().join(dirs, "project").select("project", F.when(F.col("dir") == "", F.col("w")).otherwise(F.rtrim(F.concat_ws("/", "dir", "w"), F.lit("/"))).alias("w")).distinct()
    rooted = written(rooted)
    first = written(before.where("project <> ''").select("task", "project").distinct().join(shuffled(ws.select("task")), "task", "left_semi"))
    whole = written(first.join(shuffled(wide), ["task", "project"], "left_semi").unionByName(first.join(with_outputs, "project", "left_anti").select("task", "project")))
    heads = whole.join(dirs, "project").select("task", F.col("dir").alias("w")).unionByName(first.join(shuffled(whole), ["task", "project"], "left_anti").join(rooted, "project").select("task", "w")).distinct()
    reached = _meeting(ws_reads, shuffled(heads), ["task"]).select("task")

    of = lambda df, rank: df.select("task", F.lit(rank).alias("rank"))
    own = written(of(same, 0).unionByName(of(anywhere, 1)).unionByName(of(reached, 2)).groupBy("task").agg(F.min("rank").alias("rank")))
    late = G.strides(own.select(F.lit(0).alias("origin"), F.col("task").alias("node")), upwards).select(F.col("node").alias("task"), F.lit(True).alias("late"))
    j = tasks.select("task", "cached").join(shuffled(own), "task", "left").join(shuffled(late), "task", "left")
    names = F.array(*(F.lit(x) for x in ("same-project", "workspace-output", "workspace-input")))
    because = F.coalesce(F.get(names, F.col("rank")), F.when(F.col("late"), "upstream"))
    return j.select("task", (F.coalesce("cached", F.lit(False)) & because.isNull()).alias("stable"), because.alias("because"))
