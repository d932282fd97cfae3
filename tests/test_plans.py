"""Filters, dependencies, predictions, causes, loops and timeline rows: literal cases and plain versions on random graphs."""

from __future__ import annotations

import heapq
import random
import re

import pytest
from pyspark.sql import functions as F

from weftline.functions import specs as SP
from weftline.functions import text as X
from weftline.operators import graph as G
from weftline.operators import plans as PL
from weftline.operators import selectors as SL
from weftline.operators import timeline as TL


def closure(edges, start):
    out, stack = set(), list(edges.get(start, ()))
    while stack:
        x = stack.pop()
        if x not in out:
            out.add(x)
            stack += edges.get(x, ())
    return out


# --- filters


def parsed(spark, *raws):
    rows = spark.createDataFrame([(k, r) for k, r in enumerate(raws)], "k int, raw string").select("k", SP.filter_spec(F.col("raw")).alias("f")).orderBy("k").collect()
    return [r.f.asDict() for r in rows]


def test_filters_as_typed(spark):
    flags = ["negate", "with_deps", "with_dependents", "only_deps", "only_dependents", "since_via_deps"]
    want = {
        "web": ("name", "web", set()), "!web": ("name", "web", {"negate"}), "web...": ("name", "web", {"with_deps"}), "...web": ("name", "web", {"with_dependents"}),
        "...^web": ("name", "web", {"with_dependents", "only_dependents"}), "web^...": ("name", "web", {"only_deps"}), "...web...": ("name", "web", {"with_deps", "with_dependents"}),
        "!...@s/web^...": ("name", "@s/web", {"negate", "with_dependents", "only_deps"}), "//": ("root", "", set()), "tag:ui*": ("tag", "ui*", set()), "./a/../b/": ("path", "b", set()), ".": ("path", "", set()),
        "{pk gs/x}": ("path", "pk gs/x", set()), "{./apps/*}...": ("path", "apps/*", {"with_deps"}),
    }
    for raw, f in zip(want, parsed(spark, *want), strict=True):
        assert f["error"] is None and (f["kind"], f["matcher"], {x for x in flags if f[x]}) == want[raw], (raw, f)
    ranged = parsed(spark, "[main]", "[main]...", "@s/*[HEAD~1]", "db...[main]", "{./apps/*}[main]", "web{apps}[x]", "./packages/[abc]", "...[a]...")
    assert [(f["kind"], f["matcher"], f["since"], f["since_via_deps"], f["within"]) for f in ranged] == [
        ("changed", "", "main", False, None), ("changed", "", "main", False, None), ("name", "@s/*", "HEAD~1", False, None), ("name", "db", "main", True, None),
        ("path", "apps/*", "main", False, None), ("name", "web", "x", False, "apps"), ("path", "packages/[abc]", None, False, None), ("changed", "", "a", False, None),
    ]
    errors = [f["error"] for f in parsed(spark, "", "...", "!", "^...", "tag:", "{}", "a{ }", "../x", "{a/../..}", "x^...[main]", "a\nb", "a[main]^...")]
    assert errors == ["names no project"] * 4 + ["names no tag", "names no project", "names no project", "outside the root", "outside the root", "^... before a ref", "control character", None]


def plain_star(pattern, s):
    return re.fullmatch("".join(".*" if c == "*" else re.escape(c) for c in pattern), s, re.S) is not None


def plain_path(dirs, p):
    exact = [n for n, d in dirs.items() if d == p]
    if exact:
        return exact
    under = [n for n, d in dirs.items() if (p == "" and d != "") or d.startswith(p + "/")]
    if under or "*" not in p:
        return under
    if p.endswith("/**"):
        return [n for n, d in dirs.items() if d == p[:-3] or d.startswith(p[:-2])]
    return [n for n, d in dirs.items() if d.startswith(p[:-1]) and "/" not in d[len(p) - 1 :]]


def plain_name(names, dirs, p):
    direct = [n for n, x in names.items() if plain_star(p, x)]
    if direct:
        return direct
    if "/" in p:
        return [] if p.startswith("@") else plain_path(dirs, p)
    tails = [n for n, x in names.items() if x.startswith("@") and plain_star(p, x.split("/")[1])]
    return tails if "*" in p or len(tails) == 1 else []


@pytest.mark.parametrize("seed", range(2))
def test_filters_select_what_plain_walks_select(spark, seed):
    r = random.Random(seed)
    n = 14
    names = {k: (f"@{r.choice('ab')}/" if r.random() < 0.5 else "") + r.choice(["core", "ui", "db", "web"]) + str(k % 6) for k in range(n)}
    dirs = {k: "" if k == 0 else f"{r.choice(['apps', 'packages'])}/p{k}" + ("/examples/e" if r.random() < 0.2 else "") for k in range(n)}
    tags = {k: [t for t in ("ui", "server", "lib.core") if r.random() < 0.4] for k in range(n)}
    down = {k: {j for j in range(k) if r.random() < 0.3} for k in range(n)}
    up = {k: {j for j in range(n) if k in down[j]} for k in range(n)}
    moved = {"main": {k for k in range(n) if r.random() < 0.2}, "HEAD": {k for k in range(n) if r.random() < 0.2}}

    def selector():
        kind = r.randrange(6)
        if kind == 0:
            p = r.choice([names[r.randrange(n)], "core*", "*", "@a/*", "*3", "core1", "apps/*", "packages/p3", "nothing"])
            return p, plain_name(names, dirs, p)
        if kind == 1:
            t = r.choice(["ui", "lib.*", "*", "none"])
            return f"tag:{t}", [k for k in names if any(plain_star(t, x) for x in tags[k])]
        if kind == 2:
            p = r.choice(["apps", "packages", "apps/*", "packages/**", dirs[r.randrange(1, n)], "."])
            return r.choice(["./%s", "{%s}"]) % p if p != "." else ".", plain_path(dirs, "" if p == "." else p)
        if kind == 3:
            p, d = r.choice(["core*", "*", "ui*"]), r.choice(["apps", "packages"])
            inside = set(plain_path(dirs, d))
            return f"{p}{{{d}}}", [k for k in plain_name(names, dirs, p) if k in inside]
        if kind == 4:
            ref = r.choice(["main", "HEAD"])
            return f"[{ref}]", list(moved[ref])
        p, ref, via = r.choice(["core*", "*", "ui*", "@a/*"]), r.choice(["main", "HEAD"]), r.random() < 0.5
        changed = set(moved[ref])
        if via:
            changed |= {x for k in moved[ref] for x in closure(up, k)}
        return f"{p}{'...' if via else ''}[{ref}]", [k for k in plain_name(names, dirs, p) if k in changed]

    specs, want = [], {}
    for n_list in range(40):
        include, exclude, some = set(), set(), False
        for place in range(r.randrange(1, 4)):
            text, hits = selector()
            walk = r.choice(["", "deps", "dependents", "only deps", "only dependents", "both"])
            before, after = {"": ("", ""), "deps": ("", "..."), "dependents": ("...", ""), "only deps": ("", "^..."), "only dependents": ("...^", ""), "both": ("...", "...")}[walk]
            negate = r.random() < 0.3
            some |= not negate
            out = set() if walk.startswith("only") else set(hits)
            for k in hits:
                if walk in ("deps", "only deps", "both"):
                    out |= closure(down, k)
                if walk in ("dependents", "only dependents", "both"):
                    out |= closure(up, k)
                if walk == "both":
                    out |= {y for x in closure(up, k) for y in closure(down, x)}
            (exclude if negate else include).update(out)
            specs.append((n_list, place, ("!" if negate else "") + before + text + after))
        want[n_list] = ((include if some else set(names)) - exclude, [s[2] for s in specs if s[0] == n_list])
    projects = spark.createDataFrame([(k, names[k], dirs[k], tags[k]) for k in names], "node long, name string, dir string, tags array<string>")
    edges = spark.createDataFrame([(k, j) for k, js in down.items() for j in js], "src long, dst long")
    changed = spark.createDataFrame([(ref, k) for ref, ks in moved.items() for k in ks], "since string, node long")
    got = {}
    for row in SL.apply_filters(spark.createDataFrame(specs, "list int, place int, raw string"), projects, edges, changed).collect():
        got.setdefault(row.list, set()).add(row.node)
    for k, (nodes, raws) in want.items():
        assert got.get(k, set()) == nodes, raws


def test_dependency_entries(spark):
    raws = ["build", "^build", "pkg#build", "*", "^*", "!^**", "!build", "@s/p#a#b", "", "!", "^", "^p#x", "#x", "p#", "build.*"]
    rows = spark.createDataFrame(list(enumerate(raws)), "k int, raw string").select("k", SP.dependency_spec(F.col("raw")).alias("d")).orderBy("k").collect()
    assert [(r.d.kind, r.d.project, r.d.task, r.d.negated) for r in rows] == [
        ("self", None, "build", False), ("deps", None, "build", False), ("cross", "pkg", "build", False), ("wildcardSelf", None, None, False), ("wildcardDeps", None, None, False), ("wildcardDeps", None, None, True),
        ("self", None, "build", True), ("cross", "@s/p", "a#b", False), *[(None,) * 4] * 6, ("self", None, "build.*", False),
    ]
    assert [r.d.error for r in rows[8:14]] == ["empty", "negation with no body", "no task name", "^ and # together", "no project or no task", "no project or no task"]
    # 1 -> 2 -> 3, 1 -> 4: the nearest build below 1 is behind 2, which has none
    tasks = spark.createDataFrame([(1, "build"), (1, "test"), (3, "build"), (4, "build"), (4, "test")], "node long, task string")
    edges = spark.createDataFrame([(1, 2), (2, 3), (1, 4), (4, 3)], "src long, dst long")
    projects = spark.createDataFrame([(k, f"p{k}") for k in range(1, 5)], "node long, name string")
    specs = spark.createDataFrame([(1, "build", "^build"), (1, "test", "*"), (1, "test", "^*"), (1, "test", "!^test"), (4, "test", "p3#build"), (4, "test", "nothing")], "node long, task string, raw string")
    got = sorted(map(tuple, SL.resolve_dependencies(specs, tasks, edges, projects).collect()))
    assert got == [(1, "build", 3, "build"), (1, "build", 4, "build"), (1, "test", 1, "build"), (1, "test", 3, "build"), (1, "test", 4, "build"), (4, "test", 3, "build")]


# --- small languages


def test_brace_alternatives(spark):
    want = {
        "a": ["a"], "": [""], "{a,b}": ["a", "b"], "x{a,b{1,2}}y": ["xay", "xb1y", "xb2y"], "{a,b}{c,d}": ["ac", "ad", "bc", "bd"], "{a}": ["{a}"], "{a{b,c}}": ["{ab}", "{ac}"],
        "{src,app/\\[id\\]}": ["src", "app/\\[id\\]"], "\\{a,b\\}": ["\\{a,b\\}"], "src/{a[,]b,x}.ts": ["src/a[,]b.ts", "src/x.ts"], "{a,b}/{c,d": ["a/{c,d", "b/{c,d"], "{a,{b,c}": ["{a,{b,c}"], "a}{b,c}": ["a}b", "a}c"],
        "{1..3}": ["1", "2", "3"], "{01..03}": ["01", "02", "03"], "{a..c}": ["a", "b", "c"], "{3..1}": ["3", "2", "1"], "{1..10..3}": ["1", "4", "7", "10"], "{-1..1}": ["-1", "0", "1"], "{-01..1}": ["-01", "000", "001"],
        "{A..c}": ["{A..c}"], "{1..5000}": ["{1..5000}"], "{1..{2,3}}": ["1", "2", "3"], "{a,a}": ["a"], "{,x}": ["", "x"], "{1..2..0}": ["1", "2"],
    }
    rows = spark.createDataFrame(list(enumerate(want)), "k int, p string").select("p", SP.brace_alternatives(F.col("p")).alias("a")).collect()
    for r in rows:
        assert sorted(r.a) == sorted(want[r.p]), r


def test_normal_paths(spark):
    want = {"./a/../b/": "b", "a//b/./c": "a/b/c", "..": "..", "a/../../b": "../b", "/a/./b": "/a/b", ".": "", "../../x": "../../x", "a/..": ""}
    for r in spark.createDataFrame([(p,) for p in want], "p string").select("p", X.normal_path(F.col("p")).alias("n")).collect():
        assert r.n == want[r.p], r


def test_file_locations(spark):
    code = "\x1b[1;31m"
    texts = [
        ("src/a.ts:3:7 - error\nb.js(4,2): error\nsrc/a.ts:3:7 again\nsrc/a.ts:9\nat /abs/c.ts\nhttps://x.dev/src/a.ts:1", [("src/a.ts", 3, 7), ("b.js", 4, 2), ("src/a.ts", 9, None), ("/abs/c.ts", None, None)]),
        ("\n".join(f"a.ts:{i + 1}" for i in range(60)), [("a.ts", i + 1, None) for i in range(50)]),
        # a directory chain of any length, colours in front, in between and behind
        ("d/" * 400 + "x.py:1", [("d/" * 400 + "x.py", 1, None)]), (code * 9 + "a/b.c:2\x1b[0m", [("a/b.c", 2, None)]), (f"src/{code}a.ts:1", []), (f"src/a.ts{code}:1", [("src/a.ts", None, None)]), (f"x {code}{'9' * 50}.ts", [("9" * 50 + ".ts", None, None)]),
        ("a.ts/b c.d/e.fgh/i.2", [("a.ts", None, None), ("c.d/e.fgh", None, None)]), (".env .gitignore ..x.ts a..ts x.ts. \"q/w.e\" (r.t)", [("a..ts", None, None), ("x.ts", None, None), ("q/w.e", None, None), ("r.t", None, None)]),
        ("a.ts b.ts:2 a.ts:1 ./b.ts", [("b.ts", 2, None), ("a.ts", 1, None)]), ("../up/../x.ts ./y.ts a//b.ts /r.ts", [("../x.ts", None, None), ("y.ts", None, None), ("/r.ts", None, None)]), (None, None), ("", []),
    ]
    got = spark.createDataFrame([(i, x) for i, (x, _) in enumerate(texts)], "id int, text string").select("id", X.file_locations(F.col("text")).alias("l"))
    for row in got.collect():
        assert (row.l and [tuple(x) for x in row.l]) == texts[row.id][1], row


def test_a_seed_is_carried_on(spark):
    parts = F.array(F.lit("a"), F.lit(None).cast("string"), F.lit("b"))
    of = lambda seed: spark.range(1).select(X.hex64(X.seeded_hash(parts, F.lit(seed).cast("long"))).alias("h")).first().h
    import hashlib

    def plain(seed):
        for x in ("a", "b"):
            seed ^= int(hashlib.sha256(f"{seed:016x}{x}".encode()).hexdigest()[:16], 16)
        return f"{seed:016x}"

    assert [of(0), of(7)] == [plain(0), plain(7)] and of(0) != of(7)


# --- predictions


def random_dag(seed, n=40):
    r = random.Random(seed)
    return {k: sorted({j for j in range(k) if r.random() < 2.5 / n}) for k in range(n)}, r


def frames(spark, down):
    return spark.createDataFrame([(k,) for k in down], "node long"), spark.createDataFrame([(k, j) for k, js in down.items() for j in js], "src long, dst long")


@pytest.mark.parametrize("seed", range(2))
def test_the_longest_chain_and_what_is_left_of_a_run(spark, seed):
    down, r = random_dag(seed)
    cost = {k: r.choice([0, 0, 5, 10, 20]) for k in down}
    nodes, edges = frames(spark, down)
    end, via = {}, {}
    for k in down:
        best = 0
        for d in down[k]:
            if end[d] > best:
                best, via[k] = end[d], d
        end[k] = best + cost[k]
    k, chain = min(end, key=lambda k: (-end[k], k)), []
    while k is not None:
        chain += [k] if cost[k] else []
        k = via.get(k)
    got = PL.predicted_chain(nodes.join(spark.createDataFrame(list(cost.items()), "node long, cost long"), "node"), edges).orderBy("place").collect()
    assert [x.node for x in got] == chain[::-1] and sum(x.cost for x in got) == max(end.values())

    # the live forecast, by one pass in order
    p50 = {k: r.choice([None, 10, 30]) for k in down}
    state = {k: "finished" if not down[k] and r.random() < 0.6 else "running" if r.random() < 0.2 else None for k in down}
    since, group, rank = {k: r.randrange(0, 40) for k in down}, {k: r.random() < 0.2 for k in down}, {k: r.randrange(4) for k in down}
    end, head, held, work = {}, {}, [], 0
    for k in down:
        if state[k] == "finished":
            continue
        ds = [d for d in down[k] if d in end]
        start = max((end[d] for d in ds), default=0)
        at = next((d for d in ds if end[d] == start), None)
        head[k] = k if state[k] == "running" else head.get(at)
        if state[k] != "running" and not group[k] and (by := head[k] if head[k] is not None else min(ds, default=None)) is not None:
            held.append((-rank[k], k, by))
        own = 0 if group[k] or p50[k] is None else max(0, p50[k] - (40 - since[k])) if state[k] == "running" else p50[k]
        end[k] = start + own
        work += own
    tasks = spark.createDataFrame([(k, p50[k], state[k], since[k], group[k], rank[k]) for k in down], "node long, p50 long, state string, since long, is_group boolean, rank long")
    whole, blocked = PL.live_forecast(tasks, edges, 40, 3)
    last = min(end, key=lambda k: (-end[k], k))
    assert tuple(whole.first()) == (max(end[last], work / 3), head[last], len(held))
    assert [(x.node, x.by) for x in blocked.orderBy("place").collect()] == [(k, by) for _, k, by in sorted(held)[:3]]


def test_nothing_is_predicted_without_times(spark):
    tasks = spark.createDataFrame([(1, None, None, None, False, 1), (2, None, "running", 5, False, 1)], "node long, p50 long, state string, since long, is_group boolean, rank long")
    whole, blocked = PL.live_forecast(tasks, spark.createDataFrame([(1, 2)], "src long, dst long"), 9, 2)
    assert tuple(whole.first()) == (None, None, 1) and [tuple(x) for x in blocked.collect()] == [(1, 1, 2)]


@pytest.mark.parametrize("seed", range(2))
def test_root_causes_as_a_walk_finds_them(spark, seed):
    down, r = random_dag(seed)
    own = {k for k in down if r.random() < 0.25}
    asked = [k for k in down if r.random() < 0.3]
    want = set()
    for a in asked:
        seen = {a}

        def walk(k, chain, a=a, seen=seen):
            for d in down[k]:
                if d in seen:
                    continue
                seen.add(d)
                if d in own:
                    want.update((a, d, place, n) for place, n in enumerate([*chain, d]))
                walk(d, [*chain, d])

        walk(a, [a])
    _, edges = frames(spark, down)
    one = lambda ks: spark.createDataFrame([(k,) for k in ks], "node long")
    assert {tuple(x) for x in PL.root_causes(one(asked), edges, one(own)).collect()} == want


def test_a_root_behind_a_diamond_is_named_once(spark):
    # 9 depends on 1 and 2, both on 0; through the group 5 on 4
    edges = spark.createDataFrame([(9, 1), (9, 2), (1, 0), (2, 0), (9, 5), (5, 4)], "src long, dst long")
    one = lambda *ks: spark.createDataFrame([(k,) for k in ks], "node long")
    got = sorted(map(tuple, PL.root_causes(one(9), edges, one(0, 4, 9)).collect()))
    assert got == [(9, 0, 0, 9), (9, 0, 1, 1), (9, 0, 2, 0), (9, 4, 0, 9), (9, 4, 1, 5), (9, 4, 2, 4)]


def test_one_loop_of_each_component_is_named(spark):
    edges = [(1, 2), (2, 3), (3, 1), (3, 2), (4, 4), (5, 1), (1, 6), (7, 8), (8, 9), (9, 10), (10, 7), (8, 7), (6, 11)]
    nodes, e = spark.range(1, 12).toDF("node"), spark.createDataFrame(edges, "src long, dst long")
    got = sorted(map(tuple, PL.named_loops(nodes, e).collect()))
    assert got == [(1, 0, 1), (1, 1, 2), (1, 2, 3), (4, 0, 4), (7, 0, 7), (7, 1, 8)]
    assert PL.named_loops(nodes, e.where("src = 5")).collect() == []


def test_likely_misses(spark):
    tasks = spark.createDataFrame([(1, "packages/a", True), (2, "packages/b", True), (3, "packages/c", False), (4, "", True), (5, "packages/d", True), (6, "packages/ab", True)], "node long, dir string, cached boolean")
    inputs = spark.createDataFrame([(1, "project", "src/**"), (2, "project", "docs"), (3, "project", "*.md"), (4, "workspace", "tools/*.{sh,py}"), (5, "project", "!src/**"), (6, "project", "src/**")], "node long, scope string, pattern string")
    edges = spark.createDataFrame([(2, 3), (5, 2)], "src long, dst long")
    of = lambda *paths: sorted(r.node for r in PL.likely_misses(tasks, inputs, spark.createDataFrame([(p,) for p in paths], "path string"), edges).collect())
    assert of("packages/a/src/x/y.ts") == [1] and of("packages/a/README.md") == [] and of("packages/b/docs/a/b.md") == [2, 5] and of("packages/b/docs2/a.md") == []
    # 3 isn't cached, what lies above it is
    assert of("packages/c/x.md") == [2, 5] and of("packages/c/deep/x.md") == [] and of("tools/a.py") == [4] and of("tools/x/a.py") == []
    assert of("packages/d/src/a.ts") == [] and of("packages/d/package.json") == [5] and of("yarn.lock") == [1, 2, 4, 5, 6] and of("packages/yarn.lock") == []


def test_importers_share_what_variants_reach(spark):
    # 1 -> a (variant of x), 2 -> b (variant of x), a -> 10, b -> 11
    nodes = [(1, "one"), (2, "two"), (3, "three"), (20, "x"), (21, "x"), (10, "old"), (11, "new")]
    edges = spark.createDataFrame([(1, 20), (2, 21), (20, 10), (21, 11), (3, 10)], "src long, dst long")
    importers, variants = spark.createDataFrame([(1,), (2,), (3,)], "node long"), spark.createDataFrame([("x@1", 20), ("x@1", 21), ("y@1", 10)], "variant string, node long")

    def digests(new, variants=variants, shared=""):
        n = spark.createDataFrame([(k, new if name == "new" else name) for k, name in nodes], "node long, name string")
        return {r.node: r.digest for r in PL.importer_digests(n, edges, importers, variants, shared).collect()}

    a, b, c = digests("new"), digests("newer"), digests("new", variants.where("variant = 'y@1'"), "lock")
    # what one variant reaches moves the importers of both, and no other
    assert {k for k in a if a[k] != b[k]} == {1, 2}
    assert all(a[k] != v for k, v in c.items())


# --- timeline rows


def test_rows_are_first_free(spark):
    r = random.Random(4)
    spans = []
    for k in range(900):
        track = r.choice(["hot"] * 4 + ["b", "c"])
        start = r.randrange(0, 4000) * (1 if track == "hot" else 20)
        spans.append((k, track, start, start + r.choice([0, 1, 10, 60]), "x"))
    spans += [(1000, "b", 5, 5, "x"), (1001, "b", 5, 5, "x")]
    want, by = {}, {}
    for s in sorted(spans, key=lambda s: (s[2], s[0])):
        rows = by.setdefault(s[1], [])
        at = next((k for k, end in enumerate(rows) if end <= s[2]), len(rows))
        rows[at:at + 1] = [s[3]]
        want[s[0]] = at + 1
    df = spark.createDataFrame(spans, "id long, track string, start long, stop long, other string").repartition(5)
    got = TL.timeline_rows(df, "track", cell=700).collect()
    assert {g.id: g.row for g in got} == want and len(got) == len(spans) and got[0].other == "x"
    # as many rows as run at once
    ends, peak = [], 0
    for s in sorted((s for s in spans if s[1] == "hot" and s[3] > s[2]), key=lambda s: s[2]):
        while ends and ends[0] <= s[2]:
            heapq.heappop(ends)
        heapq.heappush(ends, s[3])
        peak = max(peak, len(ends))
    assert max(g.row for g in got if g.track == "hot") in (peak, peak + 1)


def test_components_of_nothing(spark):
    nodes, edges = frames(spark, {1: [], 2: []})
    assert {tuple(x) for x in G.components(nodes, edges).collect()} == {(1, 1), (2, 2)}
    assert PL.settled(nodes, edges, F.lit(1.0), F.lit(None).cast("long")).count() == 2


# --- SQL over the relations


def test_only_one_select_is_asked(spark):
    from weftline.operators.ask import ask, guarded

    runs, other = spark.createDataFrame([(1, "a;b"), (2, "c")], "id long, t string"), spark.createDataFrame([(1, 5)], "id long, n long")
    relations = {"runs": runs, "other": other}
    rows = lambda sql, **k: sorted(map(tuple, ask(relations, sql, **k).collect()))
    assert rows("SELECT id FROM runs WHERE t = 'a;b' -- a comment; of two\n;") == [(1,)]
    assert rows("with x as (select id from runs) select x.id, o.n from x join other o on o.id = x.id /* ; */ ;;") == [(1, 5)]
    assert rows("SELECT r.id, o.id FROM runs r JOIN other o ON o.id = r.id") == [(1, 1)]
    for sql in ("DELETE FROM runs", "insert into runs values (1)", "WITH x AS (SELECT 1 AS a) INSERT INTO runs SELECT a FROM x", "", "SELECT 1; SELECT 2", "select 1; drop table runs", "DROP VIEW runs", "CREATE TABLE t AS SELECT 1"):
        with pytest.raises(ValueError, match="reads only|one statement"):
            guarded(sql)
    with pytest.raises(ValueError, match="named twice"):
        ask(relations, "SELECT r.id, o.id FROM runs r JOIN other o ON o.id = r.id", json=True)
    assert not [v.name for v in spark.catalog.listTables() if "_ask_" in v.name or v.name == "runs"]


def test_versions_go_by_their_numbers(spark):
    from weftline.operators import history as H

    rows = spark.createDataFrame([("a", "p", [1, 10]), ("b", "p", [1, 2]), ("c", "p", [3, 0]), ("d", "q", [1, 2]), ("e", "r", [1, 2])], "entry string, project string, version array<int>")
    exact = spark.createDataFrame([("b", "exact")], "entry string, v string")
    ranges = spark.createDataFrame([("p", [1, 5], [3, 0], "range"), ("p", [1, 9], [2, 0], "narrow")], "project string, lo array<int>, hi array<int>, v string")
    names = spark.createDataFrame([("p", "name p"), ("q", "name q")], "project string, v string")
    assert {r.entry: r.v for r in H.by_precedence(rows, exact, ranges, names).collect()} == {"a": "narrow", "b": "exact", "c": "name p", "d": "name q", "e": None}


def test_the_import_of_the_entry_without_modules(tmp_path):
    import pathlib
    import shutil
    import subprocess
    import sys

    root = pathlib.Path(__file__).parent.parent
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if (root / name).exists():
            shutil.copy(root / name, tmp_path)
    shutil.copytree(root / "weftline", tmp_path / "weftline", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    check = "import __spark_entry__ as e; q = e.queries(); assert q and set(e.oracle_sql()) <= set(q) and not [n for n in q if n.startswith('op') or n == 'pipeline']"
    for left in (None, "weftline/llm", "weftline/llm/__pycache__"):
        # the folder gone, left empty, and left with what an import leaves behind
        if left:
            (tmp_path / left).mkdir(parents=True)
        subprocess.run([sys.executable, "-c", check], check=True, cwd=str(tmp_path), env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})


def test_an_edge_that_two_entries_state_comes_for_each(spark):
    tasks = spark.createDataFrame([(0, "build"), (0, "test")], "node int, task string")
    projects = spark.createDataFrame([(0, "a")], "node int, name string")
    specs = spark.createDataFrame([(0, "test", "build"), (0, "test", "a#build")], "node int, task string, raw string")
    edges = spark.createDataFrame([], "src int, dst int")
    once = [tuple(r) for r in SL.resolve_dependencies(specs, tasks, edges, projects).collect()]
    assert once == [(0, "test", 0, "build")]
    assert [tuple(r) for r in SL.resolve_dependencies(specs, tasks, edges, projects, each=True).collect()] == once * 2
