"""The edge rules of single operators: nulls, ties, empty and single-row inputs."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from weftline.functions import measures as M
from weftline.functions import predicates as P
from weftline.functions import text as X
from weftline.operators import attribution, forecast, graph, history, keys, selection, stability, stats, timeline
from weftline.plans import registry
from weftline.sources import schemas


def run(id, status="success", project="p", task="t", hash="h", duration=10, run_id="r1", attempts=None, cached=True, hit=None, start=0, blocked=None, def_=None):
    hit = status in P.HITS if hit is None else hit
    return (id, project, task, hash, status, duration, attempts, cached, hit, start, start + duration, run_id, duration, 0, 1, blocked, def_)


@pytest.fixture
def runs(spark):
    return lambda *rows: spark.createDataFrame(list(rows), schemas.RUNS)


def test_percentile_takes_the_upper_middle(spark):
    df = spark.createDataFrame([(5,), (30,), (10,), (20,)], "x int")
    assert df.agg(M.nearest_rank(F.col("x"), 0.5)).first()[0] == 20
    assert df.agg(M.nearest_rank(F.col("x"), 0.99)).first()[0] == 30
    assert df.where("false").agg(M.nearest_rank(F.col("x"), 0.5)).first()[0] is None


def test_hits_count_in_rates_and_not_in_durations(runs):
    r = stats.task_stats(runs(run(1, duration=10), run(2, "cache-hit", duration=1), run(3, "failed", duration=99), run(4, "skipped")), "project", "task").first()
    assert (r.total, r.successes, r.hits, r.failures, r.p50) == (3, 2, 1, 1, 10) and r.hit_rate == pytest.approx(1 / 3)


def test_null_cache_hit_is_an_execution(spark):
    row = list(run(1))
    row[8] = None
    assert stats.task_stats(spark.createDataFrame([tuple(row)], schemas.RUNS), "project").first().p50 == 10


def test_recovery_and_flake(runs):
    assert stats.flaky_tasks(runs(run(1, "failed"), run(2))).count() == 0
    assert stats.flaky_tasks(runs(run(1), run(2, "failed"))).first().mixed == 1
    assert stats.flaky_tasks(runs(run(1, attempts=2))).first().retried == 1


def test_keyless_uncached_and_blocked_rows_never_group(runs):
    rows = [run(1, hash=""), run(2, "failed", hash=""), run(3), run(4, "failed", cached=False), run(5, "failed", blocked="x")]
    assert stats.flaky_tasks(runs(*rows)).count() == 0
    assert stats.flaky_tasks(runs(run(1), run(2, "failed", cached=None))).count() == 1


def test_tasks_that_share_a_key_do_not_mix(runs):
    assert stats.flaky_tasks(runs(run(1), run(2, "failed", task="u"))).count() == 0


def test_flaky_ties_are_in_name_order(runs):
    rows = [run(1, project="b"), run(2, "failed", project="b"), run(3, project="a"), run(4, "failed", project="a")]
    assert [r.project for r in stats.flaky_tasks(runs(*rows)).collect()] == ["a", "b"]


def test_failure_modes(runs):
    """Failures alone are breaks, however many; a retried pass or a failure after a pass makes a task flaky."""
    cases = {
        "stable": [[run(i, hash=f"h{i}") for i in range(1, 10)] + [run(10, "failed", hash="x")], [run(1, "failed", hash="y")], [run(1)], [run(i, "failed", hash=f"b{i}") for i in range(5)], [run(i, "failed") for i in range(3)], [run(1, "failed"), run(2)], [run(1, "failed", attempts=2)]],
        "flaky-fatal": [[run(1), run(2, "failed")], [run(1, "cache-hit"), run(2, "failed")], [run(1), run(2, "failed"), run(3, attempts=2)]],
        "flaky-recoverable": [[run(1, attempts=2)], [run(i) for i in range(1, 10)] + [run(10, "failed")]],
    }
    for want, histories in cases.items():
        for rows in histories:
            assert [r["mode"] for r in stats.failure_modes(runs(*rows)).collect()] == [want], rows
    assert stats.failure_modes(runs()).count() == 0


def test_failed_attempts_of_a_pass_count_as_failures(runs):
    rows = [run(1, project="web", task="test", hash="R", attempts=3), run(2, "failed", project="web", task="lint", hash="S", attempts=2)]
    got = stats.flaky_tasks(runs(*rows)).collect()
    assert [(r.project, r.task, r["keys"], r.passes, r.failures) for r in got] == [("web", "test", 1, 1, 2)]
    mixed = lambda at, project, task, passes: [run(at + i, project=project, task=task, hash=project + task) for i in range(passes)] + [run(at + passes, "failed", project=project, task=task, hash=project + task)]
    tied = mixed(0, "b", "a", 1) + mixed(10, "a", "z", 1) + mixed(20, "a", "y", 1) + mixed(30, "c", "c", 2)
    assert [f"{r.project}#{r.task}" for r in stats.flaky_tasks(runs(*tied)).collect()] == ["c#c", "a#y", "a#z", "b#a"]


def test_flaky_candidates(runs):
    history = runs(run(1, hash="a"), run(2, "failed", hash="b"), run(3, hash="c"), run(4, "failed", hash="c"), run(5, "failed", hash="d"))
    now = runs(run(11, "failed", hash="a"), run(12, hash="b"), run(13, hash="c"), run(14, "failed", hash="d"), run(15, hash="e", attempts=2), run(16, hash="f"), run(17, "failed", hash="g", attempts=3))
    got = {r.id: (r.passes, r.failures) for r in stats.flaky_candidates(history, now).collect()}
    # a first pass after failures only is a recovery, and failing on a key that never passed is a break
    assert got == {11: (1, 1), 13: (2, 1), 15: (1, 0)}
    asked = runs(run(1, hash="a"), run(2, hash="zz"), run(3, task="u", hash="zz")).select("project", "task", "hash")
    assert {(r.task, r.hash): r.flaky for r in stats.known_flaky(history, asked).collect()} == {("t", "a"): True, ("t", "zz"): True, ("u", "zz"): False}


def finished(spark, *rows):
    kind = "run_id string, status string, hash string, cached boolean, saved boolean, restored boolean"
    return spark.createDataFrame([("r", *x) for x in rows], kind)


def test_headers_tally_and_buckets(spark):
    rows = [
        ("success", "h", True, True, None), ("success", "h", True, False, None), ("success", "h", True, None, None), ("success", "h", False, None, None), ("failed", "h", True, None, None), ("failed", "", None, None, None), ("failed", "h", False, None, None),
        ("cache-hit", "h", True, None, True), ("cache-hit", "h", True, None, False), ("cache-hit", "h", True, None, None), ("cache-hit-remote", "h", True, None, True), ("cache-hit-remote", "h", True, None, False), ("skipped", "h", True, None, None), ("aborted", "h", True, None, None),
    ]
    df = finished(spark, *rows)
    t = stats.tally(df).first()
    assert (t.total, t.successful, t.failed, t.skipped, t.aborted) == (13, 9, 3, 1, 1)
    assert (t.cached_local, t.cached_remote, t.restored_local, t.restored_remote, t.up_to_date) == (3, 2, 1, 1, 3)
    h = stats.run_headers(df).first()
    assert (h.tasks, h.failed, h.hits, h.hits_local, h.hits_remote, h.up_to_date, h.restored_local, h.restored_remote) == (13, 3, 5, 3, 2, 3, 1, 1)
    got = {r.bucket: r.n for r in stats.cache_buckets(df).collect()}
    assert got == {"saved": 1, "notSaved": 1, "miss": 2, "noCache": 2, "restoredLocal": 2, "upToDate": 2, "restoredRemote": 1}


USE = "id long, project string, task string, hash string, status string, cache_hit boolean, cpu_ms long, duration_ms long, cpu_share double, cores long, peak_rss long, placement_memory long"


def test_needs_and_saturation(spark):
    use = lambda id, task, status="success", hit=False, cpu=100, ms=100, share=None, cores=4, rss=0: (id, "p", task, "h", status, hit, cpu, ms, share, cores, rss, 100)
    rows = spark.createDataFrame([
        use(1, "a", cpu=100, share=0.5), use(2, "a", cpu=400), use(3, "a", "failed", cpu=9000), use(4, "b", "cache-hit", hit=True), use(5, "c", cpu=None), use(6, "d", "failed", cpu=380, rss=95), use(7, "e", cpu=50, cores=None), use(8, "f", cpu=5000),
    ], USE)
    entries = spark.createDataFrame([("p", "b", "h", 50, 150, 7)], "project string, task string, hash string, size_bytes long, cpu_ms long, peak_rss long")
    # CPU is held against the share of the time that the run had, and never above what it was given
    assert {r.task: r.need for r in stats.mean_need(rows, entries).collect()} == {"a": 3.0, "b": 3.0, "c": None, "d": None, "e": 0.5, "f": 4.0}
    # failures count: one that filled its machine says so
    assert {r.task: (r.cores, r.memory) for r in stats.saturated(rows).collect()} == {"d": (4, 100), "f": (4, None)}
    durations = spark.createDataFrame([(1, "p", "c", "remote", 2.5), (2, "p", "c", "remote", 1.5), (3, "p", "a", "remote", 9.0), (4, "p", "c", "branch:1", 8.0)], "id long, project string, task string, source string, cpu_parallelism double")
    got = {r.task: (r.need, r.need_from) for r in forecast.resources(rows, entries, durations).collect()}
    assert got == {"a": (3.0, "own"), "b": (3.0, "hit"), "c": (1.5, "imported"), "d": (None, None), "e": (0.5, "own"), "f": (4.0, "own")}


def test_server_fold(spark):
    kind = "id long, k string, duration_ms long, cores double, rss long, at long"
    day = 86_400_000
    reports = [
        (1, "a", 100, None, 50, 0), (2, "a", 104, None, 50, 1), (3, "a", 104, 2.0, None, 2), (4, "a", 200, 2.05, 10, 3), (5, "b", 100, 1.0, 10, 0), (6, "b", 100, 1.0, 10, day), (7, "b", 101, 1.0, 10, day + 5), (8, "c", 10, None, None, 0), (9, "c", 10, None, 99, 1),
    ]
    got = {r.k: tuple(r)[1:] for r in forecast.server_fold(spark.createDataFrame(reports, kind).repartition(3), "k").collect()}
    # the second is noise; the third brings cores; the fourth moves the duration by three tenths and lets the peaks fade
    assert got["a"] == (131, pytest.approx(2.015), 45, 200, 3, 3)
    assert got["b"] == (100, pytest.approx(1.0), 10, 100, 2, day) and got["c"] == (10, None, 99, 10, 2, 1)
    stored = spark.createDataFrame([("a", 100, None, 50, 100, 1, 0), ("n", 100, 1.0, 50, 100, 1, 0), ("o", 7, None, None, 7, 1, 0)], "k string, duration_ms long, cores double, rss long, slow_ms long, runs long, updated_at long")
    new = spark.createDataFrame([("a", 200, 2.0, None, 5), ("n", 103, 1.02, 40, 5), ("x", 9, None, None, 5)], "k string, d long, c double, r long, at long")
    rows = {r.k: tuple(r)[1:] for r in forecast.server_upsert(stored, new, "k").collect()}
    assert rows == {"a": (130, 2.0, 50, 200, 2, 5), "n": (100, 1.0, 50, 100, 1, 0), "o": (7, None, None, 7, 1, 0), "x": (9, None, None, 9, 1, 5)}


def test_markdown_cells(spark):
    cells = [("a|b", r"a\|b"), (r"a\|b", r"a\|b"), (r"a\\|b", r"a\\\|b"), ("||", r"\|\|"), ("a\r\nb\rc\nd", "a b c d"), ("x" * 90, "x" * 79 + "…"), (None, None)]
    df = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(cells)], "i int, s string")
    assert [r[0] for r in df.orderBy("i").select(X.markdown_cell(F.col("s"))).collect()] == [b for _, b in cells]


def test_tasks_that_ran_at_a_moment(spark):
    spans = spark.createDataFrame([("p", "a", 0, 100_000), ("p", "a", 50, 60), ("p", "b", 40, 90), ("q", "c", 45, 54), ("q", "d", 59, 70), ("q", "e", 56, 70)], "project string, task string, start long, stop long")
    points = spark.createDataFrame([(1, 55), (2, 200_000)], "point_id long, at long")
    # three distinct tasks, the earliest first; a task with two spans counts once, and 5 ms of slack let c in
    assert [(r.point_id, r.place, r.task, r.start) for r in timeline.running_at(points, spans).orderBy("place").collect()] == [(1, 1, "a", 0), (1, 2, "b", 40), (1, 3, "c", 45)]


@pytest.mark.parametrize("cell", [1, 3, 100])
def test_neighbours_over_cells(spark, cell):
    import random

    r = random.Random(cell)
    rows = [(i, r.choice("ab"), r.choice([None, f"v{i}"])) for i in range(0, 60, 2)]
    df = spark.createDataFrame(rows, "id long, k string, v string").repartition(3)
    for later in (False, True):
        got = {x.id: x._near for x in timeline.neighbour(df, F.col("v"), "k", later=later, cell=cell).select("id", "_near").collect()}
        for i, k, _ in rows:
            near = [v for j, o, v in (reversed(rows) if later else rows) if o == k and v and (j > i if later else j < i)]
            assert got[i] == (near[-1] if near else None)


def test_limits_clamp(runs):
    rows = runs(*[run(i) for i in range(5)])
    assert [history.list_runs(rows, n).count() for n in (0, -1, 3, 10**9)] == [1, 1, 3, 5]
    assert history.list_runs(rows, project="none").count() == 0


def test_window_floor(runs, spark):
    inv = lambda *ids: spark.createDataFrame([(i, 0, 0, 1, 0, True, "") for i in ids], schemas.INVOCATIONS)
    rows = runs(run(1, run_id="a"), run(2, run_id="b"), run(3, run_id="b"))
    floor = lambda inv_, n: history.window_floor(rows, inv_, n).first().floor
    assert floor(inv("a", "b"), 3) == 0 and floor(inv("a", "b"), 1) == 2 and floor(inv("a", "b", "c"), 1) == 4


def test_prefixes(spark):
    inv = spark.createDataFrame([(i,) for i in ("abc1", "abc2", "abd", "x")], "run_id string")
    assert [history.resolve_prefix(inv, p).first().verdict for p in ("abc", "abd", "x", "q", "abc1")] == ["ambiguous", "exact", "exact", "none", "exact"]
    assert {r.run_id: r.prefix for r in history.shortest_prefix(inv, 2).collect()} == {"abc1": "abc1", "abc2": "abc2", "abd": "abd", "x": "x"}


def test_insert_or_ignore(spark):
    a, b = spark.createDataFrame([(1, "a")], "k int, v string"), spark.createDataFrame([(1, "b"), (2, "c"), (2, "c")], "k int, v string")
    assert sorted(tuple(r) for r in history.insert_or_ignore(a, b, "k").collect()) == [(1, "a"), (2, "c")]


def test_globs(spark):
    df = spark.createDataFrame([("a/b/c.ts",), ("a/c.ts",), ("ac.ts",), ("a.b",)], "p string")
    names = lambda c: {r.p for r in df.where(c).collect()}
    assert names(P.glob("p", "a*.ts")) == {"a/b/c.ts", "a/c.ts", "ac.ts"} and names(P.glob("p", "a.b")) == {"a.b"}
    assert names(P.path_glob("p", "a/**/c.ts")) == {"a/b/c.ts", "a/c.ts"} and names(P.path_glob("p", "*.ts")) == {"ac.ts"}
    assert names(P.at_or_under("p", "a")) == {"a/b/c.ts", "a/c.ts"}


def test_literals(spark):
    df = spark.createDataFrame([("512",), ("64K",), ("1.5G",), ("2m",), ("5M",), ("x",)], "s string")
    got = [(r[0], r[1]) for r in df.select(M.parse_size(F.col("s")), M.parse_duration(F.col("s"))).collect()]
    assert got == [(512, None), (65536, None), (None, None), (None, 120000), (5 << 20, None), (None, None)]


def test_measured(spark):
    df = spark.createDataFrame([(1.0,), (-1.0,), (float("nan"),), (float("inf"),), (None,), (0.0,)], "x double")
    assert [r[0] for r in df.select(P.measured("x")).collect()] == [True, False, False, False, False, True]


def test_as_of(runs):
    rows = runs(run(1, hash="a"), run(2, hash=""), run(3, hash="b"), run(4, "failed", run_id="r4"), run(5, run_id="r5"), run(6, "failed", run_id="r6"))
    assert {r.id: r.prev_id for r in timeline.previous_keyed(rows).collect()} == {1: None, 3: 1, 4: 3, 5: 4, 6: 5}
    assert {r.id: r.fixed_in for r in timeline.fixed_in(rows).collect()} == {4: "r5", 6: None}


def test_sweep_counts_ends_before_starts(spark):
    s = spark.createDataFrame([("w", 0, 10, 2, 5), ("w", 10, 20, 3, 7), ("w", 15, 16, 1, 1), ("w", 30, 30, 9, 9)], "worker string, start long, stop long, cores long, memory long")
    r = timeline.concurrency(s, "worker").first()
    assert (r.peak_open, r.busy_ms, r.core_ms) == (2, 20, 51)


def test_eviction(spark):
    e = spark.createDataFrame([("a", 1, 40), ("b", 1, 30), ("c", 9, 30)], "entry string, accessed_at long, size_bytes long")
    gone = lambda most: sorted(r.entry for r in timeline.evicted(e, most).collect())
    assert gone(100) == [] and gone(60) == ["a"] and gone(59) == ["a", "b"] and gone(0) == ["a", "b", "c"]
    assert timeline.evicted(e.where("false"), 1).count() == 0


def test_forecast_tiers(spark):
    rows = [(1, "p", "t", 5, "branch:1", 1), (2, "p", "t", 9, "remote", 1), (3, "p", "u", 7, "remote", 1), (4, "p", "v", 3, "branch:2", 1), (5, "p", "t", 8, "branch:1", 1)]
    got = {r.task: (r.expected_ms, r.tier) for r in forecast.tiered(spark.createDataFrame(rows, schemas.TASK_DURATIONS), "branch:1").collect()}
    assert got == {"t": (8, "branch"), "u": (7, "remote"), "v": (3, "any")}


def test_fold_ignores_noise(spark):
    rows = [(1, "p", 100), (2, "p", 103), (3, "p", 200)]
    r = forecast.folded(spark.createDataFrame(rows, "id long, project string, duration_ms long"), "project").first()
    assert (r.ewma, r.slow, r.counted) == (130.0, 200.0, 2)


def test_diff_and_fold(spark):
    kind = "entry long, kind string, name string, hash string"
    a = spark.createDataFrame([(1, "env", "A", "x"), (1, "file", "A", "y"), (1, "file", "B", "z")], kind)
    b = spark.createDataFrame([(2, "env", "A", "x2"), (2, "file", "A", "y"), (2, "file", "C", None)], kind)
    got = [(r.kind, r.name, r.change) for r in keys.diff(a, b.where("hash IS NOT NULL").unionByName(spark.createDataFrame([(2, "file", "C", "n")], kind))).collect()]
    assert got == [("env", "A", "changed"), ("file", "B", "removed"), ("file", "C", "added")]
    assert keys.fold(a).first().key == keys.fold(a.orderBy(F.desc("name"))).first().key != keys.fold(b).first().key


def test_graph_on_cycles_and_diamonds(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 1), (5, 6), (5, 7), (6, 8), (7, 8)], "src long, dst long")
    got = {(r.origin, r.node) for r in graph.closure(e).collect()}
    assert (1, 1) in got and (4, 3) in got and (5, 8) in got and len(got) == 9 + 3 + 3 + 1 + 1
    assert {(r.src, r.dst) for r in graph.cyclic(e).collect()} >= {(1, 2), (2, 3), (3, 1)} and not {5, 6, 7} & {r.src for r in graph.cyclic(e).collect()}
    n = spark.createDataFrame([(i, i) for i in (5, 6, 7, 8)], "node long, cost long")
    assert {r.node: r.path for r in graph.longest_paths(n, e.where("src > 4")).collect()} == {5: 5, 6: 11, 7: 12, 8: 20}
    assert graph.closure(e.where("false")).count() == 0
    assert {(r.node, r.hops, r.via) for r in graph.affected(spark.createDataFrame([(8,)], "node long"), e).collect()} == {(8, 0, None), (6, 1, 8), (7, 1, 8), (5, 2, 6)}


def test_reach_digests_follow_what_is_below(spark):
    n = spark.createDataFrame([(1, "a"), (2, "b"), (3, "b"), (4, "c")], "node long, name string")
    e = spark.createDataFrame([(1, 2), (3, 4)], "src long, dst long")
    d = {r.node: r.digest for r in graph.reach_digests(n, e).collect()}
    other = {r.node: r.digest for r in graph.reach_digests(n.where("node <> 4").unionByName(spark.createDataFrame([(4, "z")], n.schema)), e).collect()}
    assert d[2] != d[3] and d[1] == other[1] and d[3] != other[3]


def test_components_against_a_search(spark):
    import random

    rng = random.Random(7)
    for n, m in ((12, 16),):
        pairs = {(rng.randrange(n), rng.randrange(n)) for _ in range(m)}
        reach = {v: {v} for v in range(n)}
        for _ in range(n):
            for a, b in pairs:
                reach[a] |= reach[b]
        want = {v: min(w for w in range(n) if w in reach[v] and v in reach[w]) for v in range(n)}
        nodes = spark.createDataFrame([(v, f"n{v}") for v in range(n)], "node long, name string")
        edges = spark.createDataFrame(list(pairs), "src long, dst long")
        assert {r.node: r.component for r in graph.components(nodes, edges).collect()} == want
        d = {r.node: r.digest for r in graph.reach_digests(nodes, edges).collect()}
        assert len(d) == n and all((d[a] == d[b]) == (want[a] == want[b]) for a in range(n) for b in range(n))
        # a renamed node moves those that reach it and no other
        renamed = nodes.select("node", F.when(F.col("node") == 3, "zz").otherwise(F.col("name")).alias("name"))
        moved = {r.node for r in graph.reach_digests(renamed, edges).collect() if r.digest != d[r.node]}
        assert moved == {v for v in range(n) if 3 in reach[v]}


def test_digests_see_where_a_cycle_lands(spark):
    n = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "node long, name string")
    of = lambda *e: {r.digest for r in graph.reach_digests(n, spark.createDataFrame(list(e), "src long, dst long")).collect()}
    ring, turned = of((1, 2), (2, 3), (3, 1)), of((1, 3), (3, 2), (2, 1))
    assert len(ring) == len(turned) == 1 and ring != turned
    assert graph.reach_digests(n.where("false"), spark.createDataFrame([], "src long, dst long")).count() == 0


def test_server_charges(spark):
    looks = spark.createDataFrame(
        [("s", 1, [], 1.0, 100, False), ("s", 2, ["a"], 2.0, 100, False), ("s", 3, ["a", "b"], 0.5, 100, True), ("s", 4, None, None, None, None), ("z", 1, ["a"], 4.0, 10, False)],
        "server string, id long, users array<string>, cores double, ms long, capped boolean",
    )
    got = {(r.server, r.id, r.task): (round(r.base, 6), r.cost and round(r.cost, 6), r.charged and round(r.charged, 6)) for r in attribution.charges(looks).collect()}
    # base 0.3 of 1 idle core; a learns 0.3 * (2 - 0.3); the capped look lies below the model and lowers nothing
    assert got["s", 1, None] == (0.3, None, None)
    assert got["s", 2, "a"] == (0.3, 0.51, round(200 * 0.51 / 0.81, 6))
    assert got["s", 3, "a"] == (0.3, 0.51, round(50 * 0.51 / 0.81, 6)) and got["s", 3, "b"] == (0.3, 0.0, 0.0)
    assert got["s", 4, None] == (0.21, None, None)
    assert got["z", 1, "a"] == (0.0, 1.2, 40.0)
    assert attribution.charges(looks.where("false")).count() == 0


def test_stable_keys(spark):
    kind = "task long, project string, dir string, cached boolean, inputs array<string>, ws_inputs array<string>, outputs array<string>, ws_outputs array<string>, reach string"
    task = lambda id, project="p", cached=True, inputs=("src/**",), ws=(), out=(), ws_out=(), reach="none": (id, project, f"packages/{project}", cached, inputs and list(inputs), list(ws), list(out), list(ws_out), reach)

    def of(rows, edges):
        got = stability.classified(spark.createDataFrame(rows, kind), spark.createDataFrame(edges, "src long, dst long"))
        return {r.task: r.because for r in got.collect()}

    # build writes dist, tests read src: stable; a reader of dist waits, unless it takes it back
    base = [task(1, out=["dist/**"]), task(2), task(3, inputs=["dist/x.js"]), task(4, inputs=["**", "!dist/**"]), task(5, "q")]
    assert of(base, [(2, 1), (3, 1), (4, 1), (5, 3)]) == {1: None, 2: None, 3: "same-project", 4: None, 5: "upstream"}
    # undeclared writes meet everything in the project, through a task between
    assert of([task(1, cached=False, reach="project"), task(2, "q"), task(3), task(4, inputs=None)], [(2, 1), (3, 2), (4, 1)]) == {1: None, 2: None, 3: "same-project", 4: None}
    # writes at the root reach any project; a root reader waits where its globs meet a producer's outputs
    assert of([task(1, ws_out=["gen/**"]), task(2, "q")], [(2, 1)])[2] == "workspace-output"
    rooted = [task(1, out=["dist/**"]), task(2, "q", ws=["packages/p/dist/a.js"]), task(3, "q", ws=["packages/p/src/**"]), task(4, "q", ws=["**/x"])]
    assert of(rooted, [(2, 1), (3, 1), (4, 1)]) == {1: None, 2: "workspace-input", 3: None, 4: "workspace-input"}
    # one task writing inside another's tree
    assert of([task(1, out=["dist/**"]), task(2, out=["dist/sub/**"])], [(2, 1)])[2] == "same-project"


def test_sweep_and_worker_measures(spark):
    rows = spark.createDataFrame([(1, 0), (2, 86_400_000 * 40), (3, None)], "id long, updated_at long")
    at = lambda now, last: spark.createDataFrame([(now, last)], "now long, swept long")
    ids = lambda m: sorted(r.id for r in history.swept(rows, m).collect())
    now = 86_400_000 * 50
    assert ids(at(now, None)) == [2, 3] and ids(at(now, now - 1)) == [1, 2, 3] and ids(at(now, 0).where("false")) == [1, 2, 3]
    run = spark.createDataFrame([(2, 500.0, 1.2345), (4, 50.0, None), (8, 900.0, 1.0)], "size int, warm double, pace double")
    known = spark.createDataFrame([(2, 100.0), (4, 100.0)], "size int, known double")
    assert {r.size: (r.warm_ms, r.pace) for r in history.worker_measures(run, known, "size").collect()} == {2: (200.0, 1235), 4: (50.0, None), 8: (900.0, 1000)}


def test_owners_and_nesting(spark):
    p = spark.createDataFrame([("foo", "foo"), ("foo/bar", "bar"), ("foo-utils", "utils")], "dir string, name string")
    paths = spark.createDataFrame([("foo/bar/x",), ("foo/x",), ("foo-utils/x",), ("none",)], "path string")
    assert {r.path: r.owner for r in graph.owner_of(paths, p).collect()} == {"foo/bar/x": "bar", "foo/x": "foo", "foo-utils/x": "utils", "none": None}
    assert [tuple(r) for r in graph.nested_dirs(p).collect()] == [("foo", "foo/bar")]


def test_bare_names(spark):
    p = spark.createDataFrame([(1, "@a/x"), (2, "@b/x"), (3, "@a/y"), (4, "z")], "node long, name string")
    assert [[r.node for r in selection.by_name(p, n).collect()] for n in ("x", "y", "z", "@b/x")] == [[], [3], [4], [2]]


def test_nearest_names(spark):
    from weftline.functions import text as X

    names = [("BUILD", "build"), ("bulid", "build"), ("build", None), ("tset", "test"), ("last", None), ("zzzzzzz", None), (None, None), ("", None)]
    df = spark.createDataFrame(names, "name string, want string")
    assert [r.hint == r.want for r in df.select("want", X.nearest(F.col("name"), ["build", "test"]).alias("hint")).collect()] == [True] * len(names)


def test_two_stream_logs(spark):
    from weftline.functions import text as X

    logs = [("plain", [(False, "plain")]), ("", []), ("a\x1eeb\x1eoc", [(False, "a"), (True, "b"), (False, "c")]), ("\x1e\x1e\x1e", [(False, "\x1e\x1e")]), ("a\x1exb\x1e", [(False, "a\x1exb\x1e")]), ("\x1eex\x1eey", [(True, "x"), (True, "y")])]
    df = spark.createDataFrame([(i, x) for i, (x, _) in enumerate(logs)], "i int, log string")
    got = {r.i: [tuple(c) for c in r.c] for r in df.select("i", X.chunks_of_log(F.col("log")).alias("c")).collect()}
    assert got == {i: want for i, (_, want) in enumerate(logs)}


def test_sorted_json_and_definitions(spark):
    from weftline.functions import text as X

    r = spark.sql("""SELECT '{"b": {"d": 1, "c": [{"z": 1, "a": null}]}, "a": "x"}' AS j, map('b', '2', 'a', '1') AS m, map('a', '1', 'b', '2') AS n, CAST(NULL AS STRING) AS none""")
    h = lambda command, define: X.definition_hash(F.lit("p#t"), F.col(command), F.col(define))
    out = r.select(X.sorted_json(F.col("j")).alias("j"), h("j", "m").alias("a"), h("j", "n").alias("b"), h("none", "m").alias("c")).first()
    assert out.j == '{"a":"x","b":{"c":[{"a":null,"z":1}],"d":1}}' and out.a == out.b and out.c is None


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_large_groups_are_never_one_list(spark, runs):
    import random

    r = random.Random(6)
    rows = [run(i, r.choice(["success", "success", "failed", "cache-hit", "skipped"]), task=r.choice("ab"), duration=r.randrange(40), attempts=r.choice([None, 1, 2]), def_=r.choice([None, "d"])) for i in range(800)]
    rows += [run(900, "failed", task="c", def_="d")]
    got = stats.task_stats(runs(*rows), "project", "task", "def")
    assert "collect" not in plan(got)
    for g in got.collect():
        own = [x for x in rows if x[2] == g.task and x[16] == g["def"] and x[4] != "skipped"]
        took = sorted(x[5] for x in own if x[4] == "success")
        count = lambda ok: sum(map(ok, own))
        assert (g.p50, g.p99) == ((took[len(took) // 2], took[int(0.99 * len(took))]) if took else (None, None))
        assert (g.total, g.failures, g.retried) == (len(own), count(lambda x: x[4] == "failed"), count(lambda x: x[4] == "success" and (x[6] or 0) > 1))
    assert got.count() == 5
    by_project = stats.percentiles(runs(*rows), "duration_ms", {"p90": 0.9}, "project")
    assert "collect" not in plan(by_project) and by_project.first().p90 == sorted(x[5] for x in rows)[int(0.9 * len(rows))]


def test_fold_streams_each_key_in_order(spark):
    import random

    r = random.Random(7)
    rows = [(i, r.choice([None, "p", "q"]), r.choice("tu"), r.choice([None, *range(90, 130)])) for i in range(3000)]
    r.shuffle(rows)
    got = forecast.folded(spark.createDataFrame(rows, "id long, project string, task string, duration_ms long").repartition(3), "project", "task")
    assert "collect" not in plan(got)
    want = {}
    for _, project, task, d in sorted(rows, key=lambda x: x[0]):
        ewma, slow, n = want.get((project, task), (None, 0.0, 0))
        if ewma is None or d is None or abs(d - ewma) > ewma * 0.05:
            ewma = d if ewma is None or d is None else ewma * 0.7 + d * 0.3
            slow, n = max(d or 0, slow * 0.9), n + 1
        want[project, task] = ewma, slow, n
    assert {(g.project, g.task): (g.ewma, g.slow, g.counted) for g in got.collect()} == {k: (v and round(v, 3), round(s, 3), n) for k, (v, s, n) in want.items()}


def test_file_locations(spark):
    texts = [
        ("app.test.ts: failed\n at ./src/a.ts:12:5, src/a.ts(12,5) and src/a.ts:7\n app.test.ts:3 README.md", [("src/a.ts", 12, 5), ("src/a.ts", 7, None), ("app.test.ts", 3, None), ("README.md", None, None)]),
        ("see https://x.org/b.html and @scope/c.js", [("@scope/c.js", None, None)]), ("\x1b[4m/abs/a.ts:1\x1b[0m", [("/abs/a.ts", 1, None)]),
        (" ".join(f"f{i}.ts" for i in range(80)), [(f"f{i}.ts", None, None) for i in range(50)]), ("none", []), ("", []),
    ]
    got = spark.createDataFrame([(i, x) for i, (x, _) in enumerate(texts)], "id int, text string").select("id", X.file_locations(F.col("text")).alias("l"))
    for row in got.collect():
        assert [tuple(x) for x in row.l] == texts[row.id][1], row


def test_near_matches(spark):
    names = spark.createDataFrame([(x,) for x in ("build", "biuld", "guild", "Prebuild-all", "ui", "test", "buil", "unrelated", None, "buil")], "n string")
    offered = lambda name, k: [r.name for r in selection.near_matches(names, name, k).orderBy("place").collect()]
    assert offered("build", 9) == ["buil", "guild", "biuld", "Prebuild-all"]
    assert offered("build", 2) == ["buil", "guild"]
    assert offered("test-and-ui", 9) == ["test", "ui"] and offered("guide-xyz", 9) == []


def test_walks_from_every_node(spark):
    import random
    from types import SimpleNamespace

    from weftline.plans import graph_queries, more_queries

    r = random.Random(9)
    nodes = range(40)
    edges = sorted({tuple(sorted(r.sample(nodes, 2), reverse=True)) for _ in range(60)})
    dirs = {n: f"packages/b{n % 4}/p{n}" for n in nodes}
    t = SimpleNamespace(
        edges=spark.createDataFrame(edges, "src long, dst long"), nodes=spark.createDataFrame([(n,) for n in nodes], "node long"), projects=spark.createDataFrame(list(dirs.items()), "node long, dir string")
    )

    def walk(origin, on):
        seen, left = set(), [origin]
        while left:
            n = left.pop()
            new = {b for a, b in edges if a == n and (n == origin or on(n))} - seen
            seen |= new
            left += new
        return seen

    pairs = lambda df: sorted((x.origin, x.node) for x in df.collect())
    assert pairs(graph_queries.g21b(t)) == sorted((o, n) for o in nodes for n in walk(o, lambda n: n % 2 == 1))
    assert pairs(graph_queries.g18b(t)) == sorted((o, n) for o in nodes for n in walk(o, lambda n: n % 5 != 0) if n % 5 == 0)
    seeds = {n for n in nodes if n % 4 == 3}
    assert sorted(x.node for x in more_queries.g27b(t).collect()) == sorted(n for n in nodes if n in seeds or walk(n, lambda _: True) & seeds)


def test_measures_come_from_the_first_tier_with_rows(spark):
    def row(id, task, source, ms, cores=None, def_=None):
        return (id, "p", task, source, ms, cores, def_)

    rows = [row(i, "a", "branch:m", 10 * i, 1.0 * i if i % 2 else None) for i in range(1, 8)] + [row(20, "a", "remote", 999), row(21, "a", "branch:x", 998)]
    rows += [row(1, "b", "remote", 5, 2.0), row(2, "b", "remote", 7), row(3, "b", "branch:x", 100)]
    rows += [row(1, "c", "remote", 6), row(1, "d", "branch:x", 3), row(2, "d", "branch:y", 4, 4.0)]
    rows += [row(1, "e", "branch:m", 50, None, "old"), row(2, "e", "branch:x", 60, None, "new"), row(3, "e", "branch:x", 70), row(4, "f", "elsewhere", 1)]
    d = spark.createDataFrame(rows, "id long, project string, task string, source string, duration_ms long, cores double, def string")
    current = spark.createDataFrame([("p", "e", "new")], "project string, task string, def string")
    imported = spark.createDataFrame([("p", "b", 70), ("p", "a", 1)], "project string, task string, slow_ms long")
    got = {r["task"]: tuple(r)[2:] for r in forecast.tiered_measures(d, "branch:m", current, imported).collect()}
    assert got == {
        # the newest five of seven, cores of those that have some
        "a": ("own", 50, 5.0, 70), "b": ("remote", 7, None, 70), "c": ("remote", 6, None, 6), "d": ("any", 4, 4.0, 4), "e": ("any", 70, None, 70),
    }
    # whatever the definition
    assert forecast.tiered_measures(d, "branch:m").where("task = 'e'").first()[2:] == ("own", 50, None, 50)
    assert forecast.tiered_measures(d.where("false"), "branch:m", current, imported).count() == 0


def test_trace_events_count_what_is_in_use_at_each_moment(spark):
    import json

    spans = spark.createDataFrame([("w", 1, "a", 0, 10, 2, 5), ("w", 2, "b", 4, 10, 1, 1), ("w", 3, "c", 10, 12, 4, 2), ("w", 4, "d", 11, 11, 9, 9), ("w", 5, "e", 9, 3, 1, 1), ("v", 6, "f", 1, 2, 1, 1)], "k string, id long, name string, start long, stop long, cores long, memory long")
    marks = spark.createDataFrame([("w", 'lost "x"', 7)], "k string, name string, at long")
    rows = timeline.trace_events(spans, marks, "k", cell=5).collect()
    got = sorted((r["k"], r["ph"], r["ts"] // 1000, *([json.loads(r["event"])["args"][c] for c in ("cores", "memory")] if r["ph"] == "C" else [json.loads(r["event"])["name"], json.loads(r["event"])["tid"]])) for r in rows)
    assert got == [
        ("v", "C", 1, 1, 1), ("v", "C", 2, 0, 0), ("v", "X", 1, "f", 1),
        ("w", "C", 0, 2, 5), ("w", "C", 4, 3, 6), ("w", "C", 10, 4, 2), ("w", "C", 12, 0, 0),
        ("w", "X", 0, "a", 1), ("w", "X", 4, "b", 2), ("w", "X", 10, "c", 1), ("w", "X", 11, "d", 2), ("w", "i", 7, 'lost "x"', 0),
    ]
    assert timeline.trace_events(spans.where("false"), marks.where("false"), "k").count() == 0


def test_every_file_location(spark):
    # all that a text names, and one place once however its numbers are written
    names = [f"src/f{i}.ts" for i in range(130)]
    text = " ".join([*names, "src/f7.ts:03 src/f7.ts:3 src/f7.ts(3,010)"])
    rows = spark.createDataFrame([(text,)], "text string")
    got = rows.select(X.every_file_location(F.col("text")).alias("l")).first().l
    assert [tuple(x) for x in got] == [*((n, None, None) for n in names if n != "src/f7.ts"), ("src/f7.ts", 3, None), ("src/f7.ts", 3, 10)]


def test_text_locations_are_not_cut(spark, tmp_path):
    rows = [(1, " ".join(f"f{i}.ts" for i in range(70))), (2, "none")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = registry.QUERIES["Fs15b_text_locations"](spark, str(tmp_path)).collect()
    assert sorted((r.place, r.path) for r in got) == [(i, f"f{i}.ts") for i in range(70)]
