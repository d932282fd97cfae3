"""What grows with the tables is joined by shuffles: no join of it broadcasts, in any job of a query."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from weftline.functions import specs as SP
from weftline.functions import text as X
from weftline.operators import graph as G
from weftline.operators import selectors as SL
from weftline.operators import timeline as TL
from weftline.plans import registry
from weftline.sources.shared import Buckets


def plans(spark, run) -> list[str]:
    """The last plan of each execution that run() starts."""
    store, bus = spark._jsparkSession.sharedState().statusStore(), spark.sparkContext._jsc.sc().listenerBus()
    bus.waitUntilEmpty()
    first = store.executionsCount()
    run()
    bus.waitUntilEmpty()
    new = store.executionsList(int(first), 100_000)
    return [new.apply(i).physicalPlanDescription() for i in range(new.size())]


def executed(spark, run) -> list[str]:
    """As plans(), told by the ids of executions: a session keeps the last thousand, so places in its list move on."""
    store, bus = spark._jsparkSession.sharedState().statusStore(), spark.sparkContext._jsc.sc().listenerBus()

    def kept() -> list:
        bus.waitUntilEmpty()
        every = store.executionsList()
        return [every.apply(i) for i in range(every.size())]

    last = max((x.executionId() for x in kept()), default=-1)
    run()
    return [x.physicalPlanDescription() for x in kept() if x.executionId() > last]


def test_owner_of_broadcasts_nothing(spark):
    projects = spark.createDataFrame([("a", "A"), ("a/b", "B")], "dir string, name string")
    paths = spark.createDataFrame([("a/x",), ("a/b/c/y",), ("z",)], "path string")
    got = []
    seen = plans(spark, lambda: got.extend(G.owner_of(paths, projects).collect()))
    assert sorted(map(tuple, got)) == [("a/b/c/y", "B"), ("a/x", "A"), ("z", None)]
    assert seen and not any("BroadcastExchange" in p for p in seen)


@pytest.mark.parametrize("name", ["G12_changed_projects", "J16_owner", "G9c_blocked_tasks", "G8b_predicted_chain", "G13_selected", "G28_download_modes"])
def test_no_job_broadcasts(spark, sf, name):
    seen = plans(spark, lambda: registry.QUERIES[name](spark, sf).collect())
    assert seen and not any("BroadcastExchange" in p for p in seen)


def test_components_take_few_rounds(spark, monkeypatch):
    # cycles of two in a row, all of which reach the least node of all
    k = 12
    pairs = [(2 * i, 2 * i + 1) for i in range(k)] + [(2 * i + 1, 2 * i) for i in range(k)] + [(2 * i + 2, 2 * i) for i in range(k - 1)]
    tables, write = [], G.checkpointed
    monkeypatch.setattr(G, "checkpointed", lambda df: tables.append(1) or write(df))
    nodes = spark.range(2 * k + 1).withColumnRenamed("id", "node")
    got = {tuple(r) for r in G.components(nodes, spark.createDataFrame(pairs, "src long, dst long")).collect()}
    assert got == {(v, v // 2 * 2) for v in range(2 * k + 1)}
    assert len(tables) < 100


def test_a_join_after_a_walk_is_one_join(spark, sf):
    left = registry.QUERIES["G13_selected"](spark, sf)
    assert left._jdf.queryExecution().executedPlan().toString().count("SortMergeJoin") == 1


def test_words_without_an_extension_are_not_taken_apart(spark):
    rows = spark.createDataFrame([("plain words, one. Two at 3.5 and .x x. a.\x1b[1mts then src/a.ts:3 and b.C",)], "text string")
    found = rows.select(X.file_locations(F.col("text")).alias("l"))
    assert [tuple(x) for x in found.first().l] == [("src/a.ts", 3, None), ("b.C", None, None)]
    assert "filter(regexp_extract_all(" in found._jdf.queryExecution().optimizedPlan().toString()


def test_ways_are_shuffled_once(spark, sf):
    # what a walk returns lies in buckets of its nodes: neither the last distinct nor a count by node shuffles it
    for name in ("G2_closure", "G3_dependent_counts"):
        before = {t.name for t in spark.catalog.listTables()}
        out = registry.QUERIES[name](spark, sf)
        assert {t.name for t in spark.catalog.listTables()} == before
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == (1 if name == "G3_dependent_counts" else 0)  # the nodes' own side of the last join


def test_a_rounds_steps_shuffle_what_they_add_alone(spark):
    pairs = [(i, j) for i in range(60) for j in (i // 2, i // 3) if i != j]
    edges = spark.createDataFrame(pairs, "src long, dst long").distinct()
    got = []
    seen = plans(spark, lambda: got.extend(G.walks(edges, edges).collect()))
    want, more = set(pairs), True
    while more:
        more = {(a, d) for a, b in want for c, d in pairs if b == c} - want
        want |= more
    assert len(got) == len(want) and {tuple(r) for r in got} == want
    joined = [p for p in seen if "SortMergeJoin" in p]
    assert joined and all(p.split("\n\n")[0].count("Exchange") <= 2 for p in joined)


def test_a_braced_pattern_is_folded_once(spark):
    rows = spark.createDataFrame([(r"a/{b,c}/[{,]x\{y",), ("a/b,c}",), ("a{b,{c,d}",), (None,)], "p string").select(SP.brace_alternatives(F.col("p")).alias("l"))
    assert [r.l for r in rows.collect()] == [[r"a/b/[{,]x\{y", r"a/c/[{,]x\{y"], ["a/b,c}"], ["a{b,{c,d}"], [None]]
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("aggregate(") == 2


def test_run_key_diffs_looks_a_key_up_once(spark, sf):
    # runs, their keys and components are tables by then: what is left to shuffle is the join with the pairs of keys
    out = registry.QUERIES["C7b_run_key_diffs"](spark, sf)
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange") <= 2


def test_two_neighbours_share_a_window(spark):
    rows = spark.createDataFrame([(1, "a", 5), (2, "a", None), (3, "a", 7), (9, "b", 1), (12, "a", None)], "id long, k string, v int")
    out = TL.neighbours(rows, {"last": F.col("v"), "row": F.col("id")}, "k", cell=4)
    assert sorted((r.id, r.last, r.row) for r in out.collect()) == [(1, None, None), (2, 5, 1), (3, 5, 2), (9, None, None), (12, 7, 3)]
    # one shuffle of the rows, and three of what each cell hands on
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Window ") == 2


def test_origins_of_a_hub_lie_in_several_buckets(spark, monkeypatch):
    # all reach 0, by several lengths
    pairs = [(i, j) for i in range(1, 300) for j in {0, i // 2, i // 3} if i != j]
    edges = spark.createDataFrame(pairs, "src long, dst long").distinct()
    want = {tuple(r) for r in G.closure(edges).collect()}
    monkeypatch.setattr(G, "PART", len(pairs) // 5)
    out = G.closure(edges)
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    got = out.withColumn("task", F.spark_partition_id()).collect()
    assert len(got) == len(want) and {(r.origin, r.node) for r in got} == want
    assert len({r.task for r in got if r.node == 0}) > 1
    held = edges.select(F.col("src").alias("node")).where("node % 5 = 0")
    near = [tuple(r) for r in G.nearest_holders(edges, held, edges.select(F.col("src").alias("node"))).collect()]
    monkeypatch.undo()
    assert sorted(near) == sorted(tuple(r) for r in G.nearest_holders(edges, held, edges.select(F.col("src").alias("node"))).collect())


def test_filters_ask_nothing_twice(spark, sf):
    # what specs name is written in steps: one plan of all of them did each step again for every step after it
    seen = plans(spark, lambda: registry.QUERIES["G13b_filtered"](spark, sf).count())
    assert max(p.count("Exchange ") + p.count("Exchange\n") for p in seen) < 200


def test_filters_walk_several_steps_a_round(spark, monkeypatch):
    n, tables, append = 40, [], Buckets.append
    monkeypatch.setattr(Buckets, "append", lambda self, *a, **k: (tables.append(1), append(self, *a, **k))[1])
    projects = spark.createDataFrame([(i, f"n{i}", f"p/n{i}", []) for i in range(n)], "node long, name string, dir string, tags array<string>")
    edges = spark.createDataFrame([(i + 1, i) for i in range(n - 1)], "src long, dst long")
    specs = spark.createDataFrame([(1, 0, f"n{n - 1}..."), (2, 0, "...^n0"), (3, 0, "...n20...")], "list int, place int, raw string")
    got = sorted(tuple(r) for r in SL.apply_filters(specs, projects, edges, spark.createDataFrame([], "since string, node long")).collect())
    assert got == [(k, i) for k in (1, 2, 3) for i in range(n) if k != 2 or i]
    assert len(tables) < n


def test_strides_reach_what_single_steps_do(spark):
    rng = random.Random(5)
    for nodes, pairs in ((40, 55), (30, 120), (25, 25)):
        pairs = {(rng.randrange(nodes), rng.randrange(nodes)) for _ in range(pairs)} | {(i, i + 1) for i in range(nodes, nodes + 23)}
        start = {(o, rng.randrange(nodes)) for o in "abc" for _ in range(2)} | {("d", nodes)}
        want, more = set(), start
        while more:
            more = {(o, d) for o, v in more for s, d in pairs if s == v} - want
            want |= more
        out = G.strides(spark.createDataFrame(sorted(start), "origin string, node long"), G.laid(spark.createDataFrame(sorted(pairs), "src long, dst long")))
        got = [tuple(r) for r in out.collect()]
        assert len(got) == len(want) and set(got) == want


def test_steps_of_a_round_are_done_once(spark):
    # each step feeds the next one and the result; a round after the first looks up what was found before
    seen = executed(spark, lambda: G.strides(spark.createDataFrame([("a", 0)], "origin string, node long"), G.laid(spark.createDataFrame([(i, i + 1) for i in range(14)], "src long, dst long"))))
    rounds = [p for p in seen if p.count("SortMergeJoin") > G.STRIDE]
    assert len(rounds) == 3 and all(p.split("\n\n")[0].count("+- Exchange") + p.split("\n\n")[0].count(":- Exchange") <= G.STRIDE + 1 for p in rounds)


def test_dependencies_are_joined_by_shuffles(spark, sf):
    seen = executed(spark, lambda: registry.QUERIES["Fs7_dependency_edges"](spark, sf).write.format("noop").mode("overwrite").save())
    assert any("SortMergeJoin" in p for p in seen) and not any("Broadcast" in p for p in seen)


def test_stable_keys_send_no_tasks_to_all(spark, sf, tmp_path):
    # 50 copies of the tasks: only what has a row for each project or glob may be sent to all, and doesn't grow with them
    part = spark.read.parquet(f"{sf}/part.parquet")
    n = part.agg(F.max("p_partkey") + 1).first()[0]
    part.join(spark.range(50).hint("broadcast")).withColumn("p_partkey", (F.col("p_partkey") + F.col("id") * n).cast(part.schema["p_partkey"].dataType)).drop("id").write.parquet(f"{tmp_path}/part.parquet")
    seen = executed(spark, lambda: registry.QUERIES["G24_stable_keys"](spark, str(tmp_path)).write.format("noop").mode("overwrite").save())
    sent = [float(x) for p in seen for x in re.findall(r"BroadcastQueryStage[^\n]*rowCount=([\d.E+]+)", p)]
    assert sent and max(sent) < 500
