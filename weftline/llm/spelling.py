"""Groups of spelling variants: words one edit apart, found by Levenshtein automata over trie shards.

The words are cut into shards of bounded size, each a compact trie. A few
shards at a time are broadcast; every word's automaton of distance one walks
each of them depth first. What a word finds is added up over the shards.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, UPPER, scratch, stored

SHORTEST, FEWEST, TIMES = 7, 2, 10
#: One run in so many of a document loses a code point, chosen by a checksum.
PLANTED = 31
#: Letters of a shard's words (one word may be longer): a shard's trie takes 14 bytes a letter at most, 7 MB.
SHARD_LETTERS = 1 << 19
#: Bytes of tries that are broadcast at a time, about.
ROUND_BYTES = 1 << 25
#: Words a task looks up, about.
TASK_WORDS = 1 << 13
#: Distinct words, and their letters, that counting holds before it hands them on.
_HELD, _HELD_LETTERS = 1 << 17, 1 << 22
#: Texts longer than this are matched one by one instead of as a list.
_LONG = 1 << 22
_DOWN = str.maketrans(UPPER, LOWER)


def _runs(text: str, shortest: int) -> Counter:
    find = re.compile(f"[A-Za-zÀ-ÿ]{{{shortest},}}")
    raw = Counter(find.findall(text) if len(text) < _LONG else (m[0] for m in find.finditer(text)))
    out: Counter = Counter()
    for run, n in raw.items():
        out[run.translate(_DOWN)] += n
    return out


def spelled(doc_id, text: str, shortest: int = SHORTEST, planted: int = PLANTED) -> Counter:
    """The words of one text and how often each occurs. A null id is written as nothing."""
    prefix, out = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode()), Counter()
    for run, n in _runs(text, shortest).items():
        if planted and (h := zlib.crc32(run.encode(), prefix)) % planted == 0:
            k = h % len(run)
            run = run[:k] + run[k + 1 :]
            if len(run) < shortest:
                continue
        out[run] += n
    return out


def words(docs: DataFrame, shortest: int = SHORTEST, fewest: int = FEWEST, planted: int = PLANTED) -> DataFrame:
    """(word, n) over all whole texts. A task hands on sums of many documents."""

    def run(parts):
        held: Counter = Counter()
        letters = 0

        def out():
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])

        for part in parts:
            for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text"), strict=True):
                for word, n in spelled(doc_id, text.as_py() or "", shortest, planted).items():
                    if word not in held:
                        letters += len(word)
                    held[word] += n
                    if len(held) >= _HELD or letters >= _HELD_LETTERS:
                        yield out()
                        held.clear()
                        letters = 0
        yield out()

    counted = docs.select("doc_id", "text").where("text IS NOT NULL").mapInArrow(run, "word string, n bigint")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= fewest)


class Trie:
    """A compact trie of distinct sorted words in one byte a letter.

    Nodes are numbered level by level, so a node's children are neighbours:
    kids[i] to kids[i + 1]. Where only one word is left below a node the rest
    of it is the node's tail and no nodes follow. n is 0 where no word ends.
    """

    def __init__(self, labels: bytes, kids, tail_at, tail_end, n, tails: bytes):
        self.labels, self.tails = labels, tails
        # memoryviews of whole numbers: compact, and faster to read one by one than arrays
        self.kids, self.tail_at, self.tail_end, self.n = (memoryview(np.ascontiguousarray(a)) for a in (kids, tail_at, tail_end, n))

    @classmethod
    def of(cls, sorted_words: list[bytes], counts: list[int]) -> Trie:
        letters = np.frombuffer(b"".join(sorted_words), np.uint8)
        size = np.array([len(w) for w in sorted_words], np.int64)
        start = np.concatenate([[0], np.cumsum(size)[:-1]]) if len(size) else size
        many = np.array(counts, np.int64)
        labels, kid_counts, tail_at, tail_end, ends = [np.zeros(1, np.uint8)], [], [np.full(1, -1, np.int64)], [np.full(1, -1, np.int64)], [np.zeros(1, np.int64)]
        live, node, depth, made = np.arange(len(size)), np.zeros(len(size), np.int64), 0, 1
        level = 1  # nodes of the level above
        while level:
            here = size[live] > depth
            ending = live[~here]
            # a word that ends at a node with others below it
            ends[-1][node[~here]] = many[ending]
            live, node = live[here], node[here]
            char = letters[start[live] + depth]
            new = np.ones(len(live), bool)
            new[1:] = (node[1:] != node[:-1]) | (char[1:] != char[:-1])
            kid_counts.append(np.bincount(node[new], minlength=level))
            child = np.cumsum(new) - 1
            first = np.flatnonzero(new)
            alone = np.diff(np.append(first, len(live))) == 1
            only = live[first]
            labels.append(char[first])
            tail_at.append(np.where(alone, start[only] + depth + 1, -1))
            tail_end.append(np.where(alone, start[only] + size[only], -1))
            ends.append(np.where(alone, many[only], 0))
            keep = ~alone[child] if len(child) else np.zeros(0, bool)
            live, node, level = live[keep], child[keep], len(first)
            depth, made = depth + 1, made + level
        kids = np.concatenate([[1], 1 + np.cumsum(np.concatenate(kid_counts))]).astype(np.int32)
        # the last level has no row of its own in kid_counts unless it is empty, which ends the loop
        tail_at, tail_end = np.concatenate(tail_at), np.concatenate(tail_end)
        # keep only the letters of tails
        used = np.zeros(len(letters) + 1, np.int64)
        some = tail_at >= 0
        np.add.at(used, tail_at[some], 1)
        np.add.at(used, tail_end[some], -1)
        inside = np.cumsum(used)[:-1] > 0
        moved = np.concatenate([[0], np.cumsum(inside)])
        at = np.where(some, moved[np.maximum(tail_at, 0)], -1).astype(np.int32)
        end = np.where(some, moved[np.maximum(tail_end, 0)], -1).astype(np.int32)
        return cls(np.concatenate(labels).tobytes(), kids, at, end, np.concatenate(ends), letters[inside].tobytes())

    def __reduce__(self):
        return Trie, (self.labels, *(np.asarray(a) for a in (self.kids, self.tail_at, self.tail_end, self.n)), self.tails)

    @property
    def bytes(self) -> int:
        return len(self.labels) + len(self.tails) + sum(a.nbytes for a in (self.kids, self.tail_at, self.tail_end, self.n))

    def _ends(self, node: int, word: bytes, i: int) -> int:
        """n of the word that the rest of `word` from i spells below a node; 0 for none."""
        labels, kids, size = self.labels, self.kids, len(word)
        while True:
            at = self.tail_at[node]
            if at >= 0:
                return self.n[node] if self.tails[at : self.tail_end[node]] == word[i:] else 0
            if i == size:
                return self.n[node]
            node = labels.find(word[i], kids[node], kids[node + 1])
            if node < 0:
                return 0
            i += 1

    def near(self, word: bytes) -> list[tuple[int, bytes]]:
        """(n, other) of all words that differ from word by exactly one inserted, deleted or replaced letter, each once.

        The automaton stays on the word's own path for as long as it has its
        edit left; at each node it spends it in every way that the trie has
        room for, and the rest must then match. Of equal letters in a row
        only the last is deleted, and nothing is inserted before its equal, so
        no other word is met twice.
        """
        labels, kids, ends, size, out = self.labels, self.kids, self._ends, len(word), []
        node = i = 0
        while True:
            at = self.tail_at[node]
            if at >= 0:
                tail = self.tails[at : self.tail_end[node]]
                if one_edit(tail, word[i:]):
                    out.append((self.n[node], word[:i] + tail))
                return out
            low, high = kids[node], kids[node + 1]
            if i < size and (i == size - 1 or word[i] != word[i + 1]) and (n := ends(node, word, i + 1)):
                out.append((n, word[:i] + word[i + 1 :]))
            own = word[i] if i < size else -1
            after = word[i + 1] if i + 1 < size else -1
            on = -1
            for kid in range(low, high):
                c = labels[kid]
                if c == own:
                    on = kid
                    continue
                # look one letter ahead before walking down
                leaf = self.tail_at[kid] >= 0
                if (leaf or own < 0 or labels.find(own, kids[kid], kids[kid + 1]) >= 0) and (n := ends(kid, word, i)):
                    out.append((n, word[:i] + bytes((c,)) + word[i:]))
                if own >= 0 and (leaf or after < 0 or labels.find(after, kids[kid], kids[kid + 1]) >= 0) and (n := ends(kid, word, i + 1)):
                    out.append((n, word[:i] + bytes((c,)) + word[i + 1 :]))
            if on < 0:
                return out
            node, i = on, i + 1


def one_edit(a: bytes, b: bytes) -> bool:
    """Whether exactly one inserted, deleted or replaced letter makes b of a."""
    if len(a) < len(b):
        a, b = b, a
    if len(a) - len(b) > 1 or a == b:
        return False
    k = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(b))
    return a[k + 1 :] == b[k + (len(a) == len(b)) :]


def shards(counted: DataFrame, letters: int, shard_letters: int = SHARD_LETTERS) -> DataFrame:
    """(at, bytes, trie): tries of ranges of (word, n), each of at most shard_letters letters or one word."""
    import pickle

    def run(parts):
        held, many, size, made = [], [], 0, 0
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() << 32

        def out():
            trie = Trie.of(held, many)
            return pa.RecordBatch.from_arrays([pa.array([base + made]), pa.array([trie.bytes]), pa.array([pickle.dumps(trie)])], ["at", "bytes", "trie"])

        for part in parts:
            for word, n in zip(part.column("word").to_pylist(), part.column("n").to_pylist(), strict=True):
                if held and size + len(word) > shard_letters:
                    yield out()
                    held, many, size, made = [], [], 0, made + 1
                held.append(word.encode("latin-1"))
                many.append(n)
                size += len(word)
        if held:
            yield out()

    tasks = max(8, -(-letters // shard_letters))
    return counted.repartitionByRange(tasks, "word").sortWithinPartitions("word").mapInArrow(run, "at bigint, bytes bigint, trie binary")


def _met(counted: DataFrame, tries) -> DataFrame:
    """(word, n_near, best): what each word finds in the broadcast tries; best is the least (-n, other)."""

    def run(parts):
        for part in parts:
            word_of, near_of, less, other = [], [], [], []
            for word in part.column("word").to_pylist():
                own, n, best = word.encode("latin-1"), 0, None
                for trie in tries.value:
                    for many, found in trie.near(own):
                        n += 1
                        if best is None or (-many, found) < best:
                            best = (-many, found)
                if n:
                    word_of.append(word)
                    near_of.append(n)
                    less.append(best[0])
                    other.append(best[1].decode("latin-1"))
            yield pa.RecordBatch.from_arrays([pa.array(word_of, pa.string()), pa.array(near_of, pa.int64()), pa.array(less, pa.int64()), pa.array(other, pa.string())], ["word", "n_near", "less", "other"])

    return counted.select("word").mapInArrow(run, "word string, n_near bigint, less bigint, other string")


def neighbours(counted: DataFrame, shard_letters: int = SHARD_LETTERS, round_bytes: int = ROUND_BYTES) -> DataFrame:
    """(word, n, n_near, other, other_n) of (word, n): how many words are one edit away, and the most frequent of them.

    Ties go to the word that comes first in code-point order. Each round
    broadcasts tries of about round_bytes (one trie at least) and passes all
    words by them, so rounds grow with the letters of the vocabulary.
    """
    import pickle

    spark, root = counted.sparkSession, scratch(counted.sparkSession)
    size = counted.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.length("word")), F.lit(0)).alias("letters")).first()
    cut = stored(shards(counted, size["letters"], shard_letters), f"{root}/shards")
    # dealt apart: looking a word up is what takes the time
    asked = stored(counted.repartition(max(8, -(-size["n"] // TASK_WORDS)), "word"), f"{root}/asked")
    rounds: list[list[int]] = []
    held = 0
    # two numbers for each shard
    for at, n in cut.select("at", "bytes").orderBy("at").collect():
        if not rounds or held + n > round_bytes:
            rounds.append([])
            held = 0
        rounds[-1].append(at)
        held += n
    found = None
    for k, some in enumerate(rounds):
        tries = spark.sparkContext.broadcast([pickle.loads(r["trie"]) for r in cut.where(F.col("at").isin(some)).select("trie").toLocalIterator()])
        part = stored(_met(asked, tries), f"{root}/met-{k}")
        tries.destroy()
        found = part if found is None else found.unionByName(part)
    if found is None:
        return counted.select("word", "n", F.lit(0).cast("long").alias("n_near"), F.lit(None).cast("string").alias("other"), F.lit(None).cast("long").alias("other_n"))
    met = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct("less", "other")).alias("best"))
    both = counted.join(met, "word", "left")
    return both.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.col("best.other").alias("other"), (-F.col("best.less")).alias("other_n"))


def _rooted(forms: DataFrame, root: str) -> DataFrame:
    """(word, root) of (word, form): forms followed to the last. n rises tenfold with each, so a few doublings end it."""
    now, k = stored(forms.select("word", F.col("form").alias("root")), f"{root}/root-0"), 0
    while True:
        k += 1
        onward = now.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        now = stored(now.join(onward, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")), f"{root}/root-{k}")
        if now.where("_moved").isEmpty():
            return now.select("word", "root")


def forms(counted: DataFrame, times: int = TIMES, shard_letters: int = SHARD_LETTERS, round_bytes: int = ROUND_BYTES) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of (word, n).

    A word's form is the most frequent word one edit away, if that is `times`
    as frequent at least; its root is the last of the forms that follow.
    """
    root = scratch(counted.sparkSession)
    counted = stored(counted.select("word", "n"), f"{root}/words")
    near = neighbours(counted, shard_letters, round_bytes)
    often = F.col("other_n") >= times * F.col("n")
    out = stored(near.select("word", F.when(often, F.col("other")).alias("form"), "n", "n_near", F.when(often, F.col("other_n")).alias("form_n")), f"{root}/forms")
    last = _rooted(out.where("form IS NOT NULL"), root)
    return out.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def variants(docs: DataFrame, shortest: int = SHORTEST, fewest: int = FEWEST, times: int = TIMES, planted: int = 0) -> DataFrame:
    """The spelling groups of docs' whole texts, one row for each word.

    Null, empty and wordless texts add nothing; an empty table gives no row.
    Repeated rows count as often as they occur; an id only matters where
    variants are planted. Other columns are not read. A word may be of any
    length.
    """
    return forms(words(docs, shortest, fewest, planted), times)


def query(spark: SparkSession, docs: DataFrame) -> DataFrame:
    return variants(docs, planted=PLANTED)
