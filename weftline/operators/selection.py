"""Selecting projects by name, path, tag and graph walks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import predicates as P
from ..sources.shared import shuffled, written
from .graph import closure, reversed_edges


def by_name(projects: DataFrame, pattern: str) -> DataFrame:
    """Names that match; without a scope in the pattern, else the one name that matches behind its scope."""
    exact = projects.where(P.glob("name", pattern))
    if "/" in pattern or "*" in pattern:
        return exact
    bare = projects.where(F.substring_index("name", "/", -1) == pattern)
    use = exact.agg(F.count("*").alias("exact")).crossJoin(bare.agg(F.count("*").alias("bare")))
    both = exact.withColumn("_how", F.lit("exact")).unionByName(bare.withColumn("_how", F.lit("bare"))).crossJoin(F.broadcast(use))
    ok = F.when(F.col("exact") > 0, F.col("_how") == "exact").otherwise((F.col("_how") == "bare") & (F.col("bare") == 1))
    return both.where(ok).drop("_how", "exact", "bare")


def with_dependencies(selected: DataFrame, edges: DataFrame) -> DataFrame:
    # written: a join after it would be done in one task for each round of the walk
    return written(selected.select("node").unionByName(closure(edges, selected).select("node")).distinct())


def with_dependents(selected: DataFrame, edges: DataFrame) -> DataFrame:
    return with_dependencies(selected, reversed_edges(edges))


def without(included: DataFrame, excluded: DataFrame) -> DataFrame:
    """Every include comes before any exclude."""
    return included.join(shuffled(excluded.select("node")), "node", "left_anti")


def last_wins(specs: DataFrame) -> DataFrame:
    """(name) of ordered (pos, name, negated) specs whose last mention includes them."""
    return specs.groupBy("name").agg(F.max_by("negated", "pos").alias("negated")).where(~F.col("negated")).select("name")


def rule_breaks(edges: DataFrame, projects: DataFrame, rules: DataFrame) -> DataFrame:
    """Edges that a deny rule (from_tag, to_tag) forbids. Tags turn the rule into an equal join."""
    tags = projects.select("node", F.explode("tags").alias("tag"))
    a = edges.join(tags.select(F.col("node").alias("src"), F.col("tag").alias("from_tag")), "src").join(rules, "from_tag")
    b = tags.select(F.col("node").alias("dst"), F.col("tag").alias("to_tag"))
    return a.join(b, ["dst", "to_tag"]).select("src", "dst", "from_tag", "to_tag").distinct()


def near_matches(names: DataFrame, name: str, limit: int = 3) -> DataFrame:
    """Names (one column) to offer for a mistyped one, by place: up to two edits away, nearest first, then those that hold it or that it holds as a whole word.

    Containment is case-insensitive. Ties go by name; the name itself is never offered.
    """
    c = F.col("name")
    edits = F.levenshtein(F.lit(name), c)
    low, query = F.lower(c), name.lower()
    word = F.concat(F.lit(r"(?<![a-z0-9])\Q"), F.replace(low, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E(?![a-z0-9])"))
    holds = F.contains(low, F.lit(query)) | F.regexp_like(F.lit(query), word)
    rank = F.when(edits < 3, edits).when(holds, 3)
    few = names.toDF("name").distinct().where(c != name).withColumn("rank", rank).where("rank IS NOT NULL").orderBy("rank", "name").limit(limit)
    # at most limit rows
    return few.select("name", F.row_number().over(Window.orderBy("rank", "name")).cast("long").alias("place"))
