"""Affected tasks with their reasons, and key diffs of runs, on literal cases."""

from __future__ import annotations

import pytest

from weftline.operators import affected as AF
from weftline.operators import keys as K
from weftline.sources import schemas

PROJECTS = [("ui", "packages/ui"), ("web", "packages/web"), ("ui-docs", "packages/ui/docs"), ("bare", "packages/bare")]
# ui builds, tests and lints; web builds and groups; the docs inside ui build; bare has no tasks
TASKS = [(1, "ui", "build", False), (2, "ui", "test", False), (3, "ui", "lint", False), (4, "web", "build", False), (5, "web", "all", True), (6, "ui-docs", "build", False)]
INPUTS = [
    (1, "project", "src/**"), (1, "project", "!src/**/*.md"), (2, "project", "./{src,tests}/**"), (2, "workspace", "fixtures/[ab]/*.json"),
    (4, "project", "src"), (6, "project", "**/*.md"),
]
# web's build after ui's, its group after its build, ui's test and lint after its build
EDGES = [(4, 1), (5, 4), (2, 1), (3, 1)]


@pytest.fixture
def reached(spark):
    def run(*paths, named=(), outright=(), asked=range(1, 7)):
        df = lambda rows, schema: spark.createDataFrame(list(rows), schema)
        kept, steps = AF.affected_tasks(
            df(TASKS, "node long, project string, task string, grouped boolean"), df(PROJECTS, "project string, dir string"), df(INPUTS, "node long, scope string, pattern string"),
            df([(p,) for p in paths], "path string"), df(EDGES, "src long, dst long"), df([(4, "build")], "node long, name string"), df([("web", "bare"), ("bare", "ui"), ("ui", "ui-docs")], "src string, dst string"),
            df([(n, n in named, n in outright) for n in asked], "node long, named boolean, outright boolean"),
        )
        ways = {}
        for root, place, node in sorted(map(tuple, AF.chains(kept, steps).collect())):
            assert place == len(ways.setdefault(root, [])) + 1
            ways[root].append(node)
        rows = {r["node"]: r for r in kept.collect()}
        for n, r in rows.items():
            assert (r["hops"] or 0) == len(ways.get(n, [])) and (not ways.get(n) or (r["next"], r["seed"]) == (ways[n][0], ways[n][-1]))
        return {n: (r["kind"], r["file"] or r["project"], *ways.get(n, [])) for n, r in rows.items()}

    return run


def test_an_input_reaches_its_tasks_and_what_depends_on_them(reached):
    f = "packages/ui/src/a/b.ts"
    # lint has no inputs: any file of its project is its own
    assert reached(f) == {1: ("input", f), 2: ("input", f), 3: ("project", f), 4: ("input", f, 1), 5: ("input", f, 4, 1)}


def test_what_a_pattern_leaves_out_is_no_input(reached):
    # the build leaves it out, the test reads it, so the project isn't whole; web behind the build isn't reached
    f = "packages/ui/src/x/notes.md"
    assert reached(f) == {2: ("input", f), 3: ("project", f)}


def test_a_path_that_no_task_declares_reaches_the_whole_project(reached):
    f = "packages/ui/README"
    assert reached(f) == {1: ("project", f), 2: ("project", f), 3: ("project", f), 4: ("project", f, 1), 5: ("project", f, 4, 1)}


def test_a_configuration_reaches_the_whole_project_though_declared(reached):
    f = "packages/web/package.json"
    assert reached(f) == {4: ("project", f), 5: ("project", f, 4)}
    # in a directory below it is a file like others
    g = "packages/web/src/package.json"
    assert reached(g) == {4: ("input", g), 5: ("input", g, 4)}


def test_the_nearest_project_owns_a_path(reached):
    f = "packages/ui/docs/a.md"
    assert reached(f) == {6: ("input", f)}


def test_workspace_files_and_rules(reached):
    # an input by the workspace comes first and belongs to no project
    assert reached("fixtures/a/x.json") == {2: ("input", "fixtures/a/x.json")}
    assert reached("fixtures/c/x.json", "README") == {}
    # the workspace's own file reaches every task that runs, groups by what is below
    f = "workspace.config.ts"
    assert reached(f) == {n: ("workspace", f) for n in (1, 2, 3, 4, 6)} | {5: ("workspace", f, 4)}
    # a rule reaches the projects at or below its directory, and a task without inputs by the file itself
    g = "packages/ui/.gitattributes"
    assert reached(g) == {1: ("workspace", g), 2: ("workspace", g), 3: ("project", g), 6: ("workspace", g), 4: ("workspace", g, 1), 5: ("workspace", g, 4, 1)}


def test_a_package_without_tasks_that_a_spec_passes(reached):
    assert reached("packages/bare/x") == {4: ("package", "bare"), 5: ("package", "bare", 4)}


def test_named_and_selected_stay(reached):
    assert reached(named=[2], outright=[2, 3]) == {2: ("named", None), 3: ("selected", None)}
    f = "packages/web/src/x.ts"
    assert reached(f, named=[5]) == {4: ("input", f), 5: ("named", None)}
    assert reached(f, f, asked=[5, 6]) == {5: ("input", f, 4)}


def test_nothing_changed(reached):
    assert reached() == {}
    assert reached(None) == {}


def test_key_diffs_fall_back_to_the_last_saved_run(spark):
    def row(id, hash, status="success", run_id=None, cached=True, task="t"):
        return (id, "p", task, hash, status, 1, None, cached, False, id, id + 1, run_id or f"r{id}", 1, 0, 1, None, None)

    rows = [
        row(1, "k1"), row(2, "k2", "failed"), row(3, "k3"), row(4, "k3"), row(5, ""), row(6, "k4"), row(7, "k1"),
        # read only; then beside a failure; then neither kept; an uncached one; a remote one; one that is gone
        row(11, "k1", task="u"), row(12, "n1", task="u", run_id="ro"), row(13, "k3", task="u"), row(14, "n2", task="u", run_id="bad"), row(15, "k1", task="u"),
        row(16, "n3", task="u", cached=False), row(17, "n4", "cache-hit-remote", task="u"), row(18, "n5", task="u"), row(19, "n6", "failed", task="u"), row(20, "n7", task="u", run_id="ro2"), row(21, "k3", task="u"),
        row(31, "g", task="v"), row(32, "k1", task="v"),
    ]
    runs = spark.createDataFrame(rows, schemas.RUNS)
    policies = [(r[11], 1 if r[11] == "bad" else 0, "local:r,remote:r" if r[11].startswith("ro") else "local:rw,remote:") for r in rows]
    invocations = spark.createDataFrame(policies, "run_id string, failed_count long, cache_policy string")
    parts = {"k1": {"a": "1", "b": "1"}, "k3": {"a": "2", "b": "1", "c": "1"}, "k4": {"b": "1", "c": "2"}}
    components = spark.createDataFrame([(k, "file", n, h) for k, c in parts.items() for n, h in c.items()], "entry string, kind string, name string, hash string")
    got = {r["id"]: tuple(r)[4:] for r in K.run_key_diffs(runs, invocations, components).collect()}
    assert got == {
        1: (None, "first", None, 0, 0, 0, 0),
        2: ("r1", "unavailable", "ended", 0, 0, 0, 0),
        3: ("r1", "since-saved", "previous-ended", 1, 0, 1, 1),
        4: ("r3", "same-key", None, 0, 0, 0, 0),
        5: (None, "no-key", None, 0, 0, 0, 0),
        6: ("r4", "previous", None, 0, 1, 1, 1),
        7: ("r6", "previous", None, 1, 1, 0, 1),
        11: (None, "first", None, 0, 0, 0, 0),
        12: ("r11", "unavailable", "not-written", 0, 0, 0, 0),
        13: ("r11", "since-saved", "previous-not-written", 1, 0, 1, 1),
        14: ("r13", "unavailable", "beside-a-failure", 0, 0, 0, 0),
        15: ("r13", "since-saved", "previous-beside-a-failure", 0, 1, 1, 1),
        16: ("r15", "unavailable", "uncached", 0, 0, 0, 0),
        17: ("r16", "unavailable", "remote", 0, 0, 0, 0),
        18: ("r17", "unavailable", "remote", 0, 0, 0, 0),
        19: ("r18", "unavailable", "ended", 0, 0, 0, 0),
        20: ("r19", "unavailable", "not-written", 0, 0, 0, 0),
        21: ("r15", "since-saved", "previous-not-written", 1, 0, 1, 1),
        31: (None, "first", None, 0, 0, 0, 0),
        32: ("r31", "unavailable", "gone", 0, 0, 0, 0),
    }
    assert K.run_key_diffs(runs.where("false"), invocations, components).count() == 0
