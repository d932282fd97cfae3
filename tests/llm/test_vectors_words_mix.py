"""Whitening, spelling groups and mixing against brute force, and their odd inputs."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest

from weftline.llm import mixing, spelling, whitening
from weftline.llm.common import scratch
from weftline.llm.queries import QUERIES

from .fixtures import SCHEMA, odd_rows, rows

VECTORS = "vec_id bigint, embedding array<float>"


# --- whitening


def brute_whitened(table, components=16):
    """Per row its exact deviation and |whitened|, by fractions and one whole matrix."""
    fine = [(i, [int(np.floor(64 * float(c))) + 1_000_000 for c in np.array(v, np.float32)]) for i, v in table if v and all(c is not None and np.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in fine})
    n, d = len(fit), len(fit[0])
    sums = [sum(col) for col in zip(*fit, strict=True)]
    z = np.array([[float(Fraction(v) - Fraction(s, n)) for v, s in zip(x, sums, strict=True)] for x in fit])
    values, vectors = np.linalg.eigh(z.T @ z / n)
    order = np.argsort(-values)[:components]
    out = []
    for i, x in fine:
        w = np.array([float(Fraction(v) - Fraction(s, n)) for v, s in zip(x, sums, strict=True)]) @ vectors[:, order] / np.sqrt(values[order])
        out.append((i, n, sum((n * v - s) ** 2 for v, s in zip(x, sums, strict=True)), np.abs(w), values[order] / values.sum()))
    return out, d


def test_whitening_equals_brute_force(spark):
    r = np.random.default_rng(3)
    base = r.normal(size=(300, 20)).astype(np.float32) * np.linspace(0.5, 2, 20, dtype=np.float32)
    table = [(i, [float(c) for c in v]) for i, v in enumerate(base)]
    table += [(7, table[0][1])] * 150 + [(None, table[1][1]), (900, None), (901, [float("nan")] * 20), (902, [float("inf")] + [0.0] * 19), (903, [None] + [0.0] * 19)]
    want, _ = brute_whitened(table)
    got = defaultdict(list)
    for row in whitening.query(spark, spark.createDataFrame(table, VECTORS).repartition(5)).collect():
        got[row.vec_id, row.deviation].append(row)
    assert sum(map(len, got.values())) == 16 * len(want)
    for i, n, deviation, w, explained in want:
        mine = sorted(got[i, deviation], key=lambda x: x.component)
        copies = len(mine) // 16
        assert copies * 16 == len(mine) and {x.n for x in mine} == {n}
        assert np.allclose([abs(x.whitened) for x in mine[::copies]], w, rtol=1e-9, atol=1e-9)
        assert np.allclose([x.explained for x in mine[::copies]], explained, rtol=1e-9)
        assert all(x.identity_error < 1e-9 for x in mine)
    signs = np.sign([x.whitened for k in sorted(got, key=str) for x in sorted(got[k], key=lambda x: x.component)[:: len(got[k]) // 16]])
    assert set(signs) == {-1.0, 1.0}


def test_whitening_of_the_test_table(spark, sf):
    import duckdb

    table = duckdb.sql(f"SELECT vec_id, embedding FROM '{sf}/embeddings.parquet'").fetchall()
    want, d = brute_whitened(table)
    got = {(r.vec_id, r.component): r for r in QUERIES["op11_whitening"](spark, sf).collect()}
    assert len(got) == len(want) * min(16, d)
    for i, n, deviation, w, explained in want:
        mine = [got[i, c + 1] for c in range(16)]
        assert {(x.n, x.deviation) for x in mine} == {(n, deviation)}
        assert np.allclose([abs(x.whitened) for x in mine], w, rtol=1e-7, atol=1e-9) and np.allclose([x.explained for x in mine], explained)


def test_whitening_of_few_ragged_and_huge_vectors(spark):
    kind = "vec_id bigint, embedding array<double>, n string, _x int"
    one = spark.createDataFrame([(1, [0.5, 0.25], "a", 1), (2, [0.5, 0.25], "b", 2)], kind)
    out = whitening.whiten(one, whitening.fit(one))
    assert out.columns[:3] == ["vec_id", "embedding", "_x"] and out.columns.count("n") == 1 and {r["_x"] for r in out.collect()} == {1, 2}
    for row in out.collect():
        assert (row.n, row.deviation, row.whitened, row.explained, row.identity_error) == (1, 0, [None, None], [0.0, 0.0], 0.0)
    # each length by itself, no entries no row
    ragged = spark.createDataFrame([(1, [0.0, 1.0]), (2, [1.0, 0.0]), (3, [1.0]), (4, [3.0]), (5, [])], "vec_id bigint, embedding array<double>")
    got = sorted((r.vec_id, r.component, r.n, r.deviation, r.whitened if r.whitened is None else abs(round(r.whitened, 9))) for r in whitening.query(spark, ragged).collect())
    assert got == [(1, 1, 2, 8192, 1.0), (1, 2, 2, 8192, None), (2, 1, 2, 8192, 1.0), (2, 2, 2, 8192, None), (3, 1, 2, 16384, 1.0), (4, 1, 2, 16384, 1.0)]
    # what doesn't fit in a long is its end
    huge = spark.createDataFrame([(1, [1e300, 0.0]), (2, [-1e300, 1.0]), (3, [0.0, 2.0])], "vec_id bigint, embedding array<double>")
    got = whitening.query(spark, huge).collect()
    assert {r.deviation for r in got if r.vec_id < 3} == {(1 << 63) - 1} and {r.deviation for r in got if r.vec_id == 3} != {(1 << 63) - 1} and all(r.identity_error < 1e-4 for r in got)
    assert whitening.query(spark, huge.limit(0)).collect() == []


@pytest.mark.parametrize("n", [3, 1 << 20, 1 << 33])
def test_deviations_are_exact(n):
    r = random.Random(n)
    x = np.array([[r.randrange(-300, 300) + 1_000_000 for _ in range(8)] for _ in range(5)], np.int64)
    sums = [n * 1_000_000 + r.randrange(-n, n) for _ in range(8)]
    f = whitening.Fit(n, sums, np.empty((8, 0)), np.empty(0))
    want = [min(sum((n * int(v) - s) ** 2 for v, s in zip(row, sums, strict=True)), (1 << 63) - 1) for row in x]
    assert whitening._deviations(x, f) == want


# --- spelling


def brute_words(table, planted=31, shortest=7, fewest=2):
    n = Counter()
    for doc_id, text, *_ in table:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if planted and h % planted == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: k for w, k in n.items() if len(w) >= shortest and k >= fewest}


def brute_edits(a, b):
    """Levenshtein distance by the whole table."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def brute_forms(n, times=10):
    near = {w: [v for v in n if abs(len(v) - len(w)) < 2 and brute_edits(v, w) == 1] for w in n}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-n[v], v), default=None)
        if best and n[best] >= times * n[w]:
            form[w] = best
    out = set()
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.add((w, form.get(w), root, n[w], len(near[w]), n[form[w]] if w in form else None))
    return out


def as_rows(df):
    return {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


def spelling_table(seed=5):
    r = random.Random(seed)
    stems = ["".join(r.choice("abé") for _ in range(r.randrange(6, 12))) for _ in range(25)] + ["aaaaaaa", "aaaaaaaa", "aaaaaaaaa", "ababababab", "babababab"]
    weights = [3 ** r.randrange(0, 7) for _ in stems]
    table = [(i, " ".join(w.title() if r.random() < 0.3 else w for w in r.choices(stems, weights, k=200)) + " ÀÉ÷xyzabc", "en", "s", 1) for i in range(40)]
    return table + odd_rows() + [(None, " ".join(["b" * 400, "b" * 401] * 2), "en", "s", 1), (77, "", "en", "s", 1)]


@pytest.mark.parametrize(("shard_letters", "round_bytes"), [(1 << 19, 1 << 25), (100, 3000), (1, 1)])
def test_spelling_equals_brute_force_whatever_the_shards(spark, shard_letters, round_bytes):
    table = spelling_table()
    n = brute_words(table)
    if shard_letters == 1:  # one word a shard and one shard a round
        n = dict(sorted(n.items())[:6])
    counted = spark.createDataFrame(list(n.items()), "word string, n bigint")
    assert as_rows(spelling.forms(counted, shard_letters=shard_letters, round_bytes=round_bytes)) == brute_forms(n)


def test_spelling_query_equals_brute_force(spark):
    table = spelling_table() + rows()
    want = brute_forms(brute_words(table))
    docs = spark.createDataFrame([(*t, "x") for t in table], SCHEMA + ", word string").repartition(3)
    assert as_rows(spelling.query(spark, docs)) == want and any(w[1] for w in want)
    assert as_rows(spelling.variants(docs)) == brute_forms(brute_words(table, planted=0))
    assert as_rows(spelling.query(spark, docs.limit(0))) == set()
    assert as_rows(spelling.query(spark, spark.createDataFrame([(1, None), (2, "a b c")], "doc_id bigint, text string"))) == set()


def test_forms_are_followed_to_the_last(spark):
    words = [("aaaaaaaa", 3), ("aaaaaaab", 30), ("aaaaaabb", 300), ("aaaaabbb", 3000), ("aaaabbbb", 30000), ("aaabbbbb", 300000)]
    got = as_rows(spelling.forms(spark.createDataFrame(words, "word string, n bigint")))
    assert {(g[0], g[2]) for g in got} == {(w, "aaabbbbb") for w, _ in words}


def test_a_trie_finds_every_neighbour_once():
    r = random.Random(1)
    words = sorted({bytes(r.choice(b"abc") for _ in range(r.randrange(1, 8))) for _ in range(600)})
    trie = spelling.Trie.of(words, [k + 1 for k in range(len(words))])
    place = {w: k + 1 for k, w in enumerate(words)}
    for word in [*words, b"", b"abcabcabcabc", b"zzz"]:
        found = trie.near(word)
        assert len(found) == len(set(found))
        assert sorted(found) == sorted((place[w], w) for w in words if abs(len(w) - len(word)) < 2 and brute_edits(w, word) == 1)


# --- mixing


def brute_targets(words, weights=(3, 1, 2)):
    """Shares by weight, held at twice a source's words, in fractions."""
    order = sorted((s for s in words if s is not None), key=lambda s: s.encode()) + [s for s in words if s is None]
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    full, open_ = {}, set(words)
    while True:
        left = Fraction(3 * sum(words.values()), 2) - sum(full.values())
        share = {s: left * weight[s] / sum(weight[t] for t in open_) for s in open_}
        over = {s for s in open_ if share[s] > 2 * words[s]}
        if not over:
            return {**full, **share}
        full |= {s: Fraction(2 * words[s]) for s in over}
        open_ -= over


def brute_sainte_lague(votes, seats, most):
    won = dict.fromkeys(votes, 0)
    for _ in range(min(seats, sum(most.values()))):
        p = min((p for p in votes if won[p] < most[p]), key=lambda p: (-Fraction(votes[p]) / (2 * won[p] + 1), p))
        won[p] += 1
    return won


@pytest.mark.parametrize("seed", range(3))
def test_apportionment_equals_one_seat_at_a_time(spark, seed):
    r = random.Random(seed)
    parties, seats, want = [], [], {}
    for grp in range(4):
        votes = {p: r.choice([1, 1, 2, 5, 40, 1000]) for p in range(r.randrange(1, 25))}
        most = {p: r.randrange(1, 60) for p in votes}
        n = r.randrange(0, 120)
        parties += [(grp, p, float(v), most[p]) for p, v in votes.items()]
        seats.append((grp, n))
        want |= {(grp, p): k for p, k in brute_sainte_lague(votes, n, most).items()}
    got = mixing.apportion(spark.createDataFrame(parties, "grp bigint, party bigint, votes double, most bigint"), spark.createDataFrame(seats, "grp bigint, seats bigint"), scratch(spark))
    assert {(g.grp, g.party): g.quota for g in got.collect()} == want


def mix_table(seed=2):
    r = random.Random(seed)
    out = []
    for i in range(400):
        source = r.choice(["hot"] * 6 + ["b", "é", "Z", "a", None, "small"])
        size = r.randrange(0, 6) if source == "small" else r.randrange(0, 300)
        out.append((i, " ".join(f"w{k}" for k in range(size)), "en", source, 1))
    # a repeated row, ids without a value, texts without a word, a source without any, one very long text
    return out + [out[3]] * 3 + [(None, "no id", "en", "b", 1), (None, None, None, "b", None), (5, " \n\t", None, "none", 1), (6, " ", "en", "b", 1), (7, "x " * 9_000, "en", "long", 1)]


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0d]+", text or "")


def test_mix_comes_near_its_targets_and_reruns_agree(spark):
    table = mix_table()
    words = Counter()
    for _, text, _, source, _ in table:
        words[source] += len(words_of(text))
    want = brute_targets(words)
    docs = spark.createDataFrame([(*t, 1) for t in table], SCHEMA + ", taken int")
    got = mixing.mix(docs.repartition(3), shard=2_000).collect()
    assert sorted((r.doc_id or -1, r.size) for r in got) == sorted((t[0] or -1, len(words_of(t[1]))) for t in table)
    taken = Counter()
    for r in got:
        assert 0 <= r.taken <= 2 * r.size and r.source_size == words[r.source] and r.target == pytest.approx(float(want[r.source]))
        taken[r.source] += r.taken
    # a block and the short last ones of the shards
    assert all(abs(taken[s] - want[s]) <= max(0.01 * want[s], 2) for s in words)
    again = mixing.mix(docs.repartition(7, "text"), shard=2_000, spans=True).collect()
    assert sorted(map(str, (r[:6] for r in got))) == sorted(map(str, (r[:6] for r in again)))
    for r in again:
        assert sum((s.end - s.start) * s.copies for s in r.spans) == r.taken
        assert all(0 <= s.start < s.end <= r.size and 0 < s.copies <= 2 for s in r.spans) and all(a.end <= b.start for a, b in zip(r.spans, r.spans[1:], strict=False))
    other = mixing.mix(docs, shard=2_000, seed=99).collect()
    assert sorted(map(str, (r[:6] for r in other))) != sorted(map(str, (r[:6] for r in got))) and {r.source: r.target for r in other} == {r.source: r.target for r in got}


def test_mix_of_the_test_table(spark, sf):
    got = QUERIES["op13_mixing"](spark, sf).collect()
    by = defaultdict(int)
    for r in got:
        assert r.taken <= 2 * r.size
        by[r.target, r.source_size] += r.taken
    assert all(abs(n - target) <= 0.01 * target for (target, _), n in by.items()) and len(got) == len(set(got))


def test_mix_of_little(spark):
    assert mixing.query(spark, spark.createDataFrame([], SCHEMA)).collect() == []
    got = mixing.query(spark, spark.createDataFrame([(1, None, "en", "a", 1), (2, "", "en", None, 1)], SCHEMA)).collect()
    assert sorted(map(tuple, got)) == [(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)]
    got = mixing.query(spark, spark.createDataFrame([(1, "one two three", "en", "a", 1)], SCHEMA)).collect()
    assert [(r.size, r.source_size, r.target) for r in got] == [(3, 3, 4.5)] and got[0].taken in (4, 5)


def test_blocks_are_drawn_by_seed():
    a = mixing.drawn(1000, 300, 1)
    assert a.sum() == 300 and set(a) == {0, 1} and (a == mixing.drawn(1000, 300, 1)).all() and (a != mixing.drawn(1000, 300, 2)).any()
    assert sorted(set(mixing.drawn(10, 13, 5)[:10])) == [1, 2] and mixing.drawn(10, 20, 5).sum() == 20
