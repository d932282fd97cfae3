"""Substring dedup by relative Lempel-Ziv parsing.

Reference blocks are found by anchors: every window of words has one, the least
hash of the short word groups in it, and the words that the windows around one
anchor reach make a block. All blocks of the corpus are indexed by anchor. Each
anchor with several different blocks has a reference block, the most frequent
one, of these the first. Every other block of the anchor is factored against
it: the match through the anchor is extended greedily, word by word, to both
sides. What is matched over a whole window is a factor, and all windows inside
it repeat. At the factor boundaries, where a window leaves the match, the
reference can't tell: those windows are looked up among the blocks of the
anchor, by hash first and then by their words. Blocks that have equal content
are copied whole, and an anchor with one block is literal text. Factors of
neighbouring blocks from one place run together: factors() returns them.

No step pairs occurrences with each other: a block meets one reference block,
anchors, contents and boundary windows are counted. Contents are told apart by
128 bits of two hashes, factors and boundary windows by words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import Remembered
from .common import packed, row_key, scratch, stored, with_made
from .near_dedup import _mix

#: Two bases of polynomial hashes.
_BASES = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95
_powers = [(np.ones(1, np.uint64), np.ones(1, np.uint64))] * 2
_hashes: Remembered | None = None


def words_of(text: str | None) -> list[bytes]:
    """Maximal runs of what isn't space or tab to carriage return; bytes.split() has just these six."""
    return (text or "").encode().split()


def hashed(words: list[bytes]) -> np.ndarray:
    global _hashes
    if _hashes is None:
        _hashes = Remembered(xxhash.xxh3_64_intdigest, 500_000)
    return np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))


def _power_tables(n: int, which: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a base and of its inverse modulo 2**64, n at least."""
    if len(_powers[which][0]) < n:
        size, base = max(n, 1 << 16), _BASES[which]
        _powers[which] = tuple(np.concatenate([[np.uint64(1)], np.cumprod(np.full(size - 1, b, np.uint64), dtype=np.uint64)]) for b in (base, pow(base, -1, 1 << 64)))
    return _powers[which]


class Hasher:
    """Hashes of any stretch of words in constant time."""

    def __init__(self, h: np.ndarray, which: int = 0):
        up, self.down = _power_tables(len(h) + 1, which)
        h = h if not which else _mix(h)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * up[: len(h)], dtype=np.uint64)])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mix((self.sums[end] - self.sums[start]) * self.down[start])


def group_size(window: int) -> int:
    return max(1, min(8, window // 4))


def blocks(h: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """Place of the anchor, its hash, least and most distance of a window's start to it, and two content hashes, for each block of a document."""
    if len(h) < window:
        return tuple(np.empty(0, np.int64) for _ in range(6))
    of = Hasher(h)
    k = group_size(window)
    at = np.arange(len(h) - k + 1)
    groups = of(at, at + k)
    reach = window - k + 1
    # the last least group of each window; halves of a window overlap, so its minimum comes from powers of two
    place, value, size = at, groups, 1
    while size < reach:
        step = min(size, reach - size)
        a, b = value[: len(value) - step], value[step:]
        right = b <= a
        place, value, size = np.where(right, place[step:], place[: len(place) - step]), np.where(right, b, a), size + step
    first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    end = np.concatenate([first[1:], [len(place)]])
    anchor = place[first]
    contents = [f(first, end - 1 + window).view(np.int64) for f in (of, Hasher(h, 1))]
    return anchor, groups[anchor].view(np.int64), anchor - (end - 1), anchor - first, *contents


INDEX = "_id bigint, _th bigint, place int, anchor bigint, low int, high int, c1 bigint, c2 bigint"


def _index(docs: DataFrame, window: int) -> DataFrame:
    """The blocks of each row."""

    def run(parts):
        kinds = [pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
        for part in parts:
            row, cols = [], [[] for _ in kinds]
            for i, text in enumerate(part.column("text").to_pandas()):
                own = blocks(hashed(words_of(text)), window)
                row.append(np.full(len(own[0]), i))
                for c, x in zip(cols, own, strict=True):
                    c.append(x)
            if not row:
                continue
            at = pa.array(np.concatenate(row).astype(np.int64))
            arrays = [part.column("_id").take(at), part.column("_th").take(at), *(pa.array(np.concatenate(c)).cast(k) for c, k in zip(cols, kinds, strict=True))]
            yield pa.RecordBatch.from_arrays(arrays, [x.split()[0] for x in INDEX.split(", ")])

    return docs.select(*row_key(), "text").mapInArrow(run, INDEX)


BLOCK = "anchor bigint, c1 bigint, c2 bigint, held bigint, low int, high int, _id bigint, _th bigint, place int, words string"


def _reference_words(texts: DataFrame, window: int) -> DataFrame:
    """The words of the blocks that texts list as refs."""

    def run(parts):
        names = [x.split()[0] for x in BLOCK.split(", ")]
        schema = pa.schema([(n, {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[k]) for n, k in (x.split() for x in BLOCK.split(", "))])
        for part in parts:
            cols = [[] for _ in names]
            for text, id_, th, refs in zip(part.column("text").to_pandas(), part.column("_id").to_pylist(), part.column("_th").to_pylist(), part.column("refs").to_pylist(), strict=True):
                words = words_of(text)
                for r in refs:
                    own = b" ".join(words[r["place"] - r["high"] : r["place"] - r["low"] + window]).decode()
                    for c, x in zip(cols, (r["anchor"], r["c1"], r["c2"], r["held"], r["low"], r["high"], id_, th, r["place"], own), strict=True):
                        c.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, schema.types, strict=True)], names)

    return texts.select("text", "_id", "_th", "refs").mapInArrow(run, BLOCK)


def matched(words: list[list[bytes]], at: np.ndarray, others: list[list[bytes]], other_at: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """How many words before each anchor, and from it on, equal those of the other text around its anchor: greedy extension to both sides."""
    codes: dict[bytes, int] = {}
    tables = []
    for texts, places, nothing in ((words, at, -1), (others, other_at, -2)):
        table = np.full((len(texts), 2 * window), nothing, np.int64)
        for i, (own, place) in enumerate(zip(texts, places.tolist(), strict=True)):
            table[i, window - place : window - place + len(own)] = [codes.setdefault(w, len(codes)) for w in own]
        tables.append(table)
    same = tables[0] == tables[1]
    return same[:, window - 1 :: -1].cumprod(axis=1).sum(axis=1), same[:, window:].cumprod(axis=1).sum(axis=1)


def factored(met: DataFrame, window: int) -> DataFrame:
    """Each block against its anchor's reference block (other, other_high): left and right, the words matched to both
    sides of the anchor; mask, with bit b for the window that starts b words before it and lies in the factor; rest,
    the windows that cross a factor boundary, with their hashes."""
    schema = "anchor bigint, c1 bigint, c2 bigint, held bigint, left int, right int, mask bigint, rest array<struct<bit:int,h1:bigint,h2:bigint>>"

    def run(parts):
        bits = np.arange(window)
        for part in parts:
            if not part.num_rows:
                continue
            words = [w.encode().split() for w in part.column("words").to_pylist()]
            low, high = (part.column(c).to_numpy()[:, None] for c in ("low", "high"))
            others = [w.encode().split() for w in part.column("other").to_pylist()]
            left, right = matched(words, high[:, 0], others, part.column("other_high").to_numpy(), window)
            own = (bits >= low) & (bits <= high)
            inside = own & (bits <= left[:, None]) & (window - bits <= right[:, None])
            mask = (inside * (np.int64(1) << bits)).sum(axis=1)
            row, bit = np.nonzero(own & ~inside)
            flat = hashed([w for own_words in words for w in own_words])
            starts = np.concatenate([[0], np.cumsum([len(w) for w in words])])[row] + high[row, 0] - bit
            h1, h2 = (Hasher(flat, k)(starts, starts + window).view(np.int64) for k in (0, 1))
            rest = pa.StructArray.from_arrays([pa.array(bit.astype(np.int32)), pa.array(h1), pa.array(h2)], ["bit", "h1", "h2"])
            offsets = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(words)))]).astype(np.int32)
            arrays = [*(part.column(c) for c in ("anchor", "c1", "c2", "held")), pa.array(left.astype(np.int32)), pa.array(right.astype(np.int32)), pa.array(mask), pa.ListArray.from_arrays(pa.array(offsets), rest)]
            yield pa.RecordBatch.from_arrays(arrays, [x.split()[0] for x in schema.replace(":", " ").replace("array<struct<", " ").split(", ")][:8])

    return met.select("anchor", "c1", "c2", "held", "low", "high", "words", "other", "other_high").mapInArrow(run, schema)


def _window_words(asked: DataFrame, window: int) -> DataFrame:
    """(anchor, bit, words, held, c1, c2) of the windows of asked blocks whose bits are set in open."""
    schema = "anchor bigint, c1 bigint, c2 bigint, held bigint, bit int, own string"

    def run(parts):
        for part in parts:
            row, bits, own = [], [], []
            for i, (text, high, mask) in enumerate(zip(part.column("words").to_pylist(), part.column("high").to_pylist(), part.column("open").to_pylist(), strict=True)):
                words = text.split(" ")
                for b in range(window):
                    if mask >> b & 1:
                        row.append(i)
                        bits.append(b)
                        own.append(" ".join(words[high - b : high - b + window]))
            at = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays([*(part.column(c).take(at) for c in ("anchor", "c1", "c2", "held")), pa.array(bits, pa.int32()), pa.array(own, pa.string())], [x.split()[0] for x in schema.split(", ")])

    return asked.select("anchor", "c1", "c2", "held", "high", "words", "open").mapInArrow(run, schema)


class Parse:
    """The parse of docs: shared blocks, reference blocks and factors, as written tables."""

    def __init__(self, docs: DataFrame, window: int):
        self.window, self.root = window, scratch(docs.sparkSession)
        own = _index(docs, window)
        ends = [f(c).alias(f"{f.__name__}_{c}") for c in ("c1", "c2") for f in (F.min, F.max)]
        shared = own.groupBy(F.col("anchor").alias("_a")).agg(F.count(F.lit(1)).alias("held"), *ends).where("held > 1")
        # written first: both sides of the join below are then plain shuffles, whose large parts Spark can split
        shared = stored(shared.select("_a", F.expr("min_c1 = max_c1 AND min_c2 = max_c2").alias("whole")), f"{self.root}/anchors")
        found = own.join(shared, F.col("anchor") == F.col("_a")).drop("_a")
        #: All blocks of anchors that have several; whole: they are all equal.
        self.found = stored(found, f"{self.root}/shared")
        self.edges = self.found.where(~F.col("whole"))

        refs = self.edges.groupBy("anchor", "c1", "c2").agg(F.min(F.struct("_id", "_th", "place", "low", "high")).alias("r"), F.count(F.lit(1)).alias("held"))
        refs = refs.groupBy(F.col("r._id").alias("_rid"), F.col("r._th").alias("_rth")).agg(F.collect_list(F.struct("r.place", "r.low", "r.high", "anchor", "c1", "c2", "held")).alias("refs"))
        # rows that are equal in id and text share a key: one of them serves
        texts = docs.select(*row_key(), "text").join(refs, (F.col("_id") == F.col("_rid")) & (F.col("_th") == F.col("_rth"))).dropDuplicates(["_id", "_th"])
        #: One block of each content that isn't the only one of its anchor, with its words.
        self.blocks = stored(_reference_words(texts, window), f"{self.root}/blocks")

        top = self.blocks.groupBy(F.col("anchor").alias("_a")).agg(F.min(F.struct((-F.col("held")).alias("n"), "_id", "_th", "place", "c1", "c2")).alias("top")).select("_a", "top.c1", "top.c2")
        is_top = (F.col("anchor") == F.col("_a")) & (self.blocks["c1"] == top["c1"]) & (self.blocks["c2"] == top["c2"])
        central = self.blocks.join(top.hint("merge"), is_top).select("_a", top["c1"].alias("_c1"), top["c2"].alias("_c2"), F.col("words").alias("other"), F.col("high").alias("other_high"), F.col("_id").alias("source"), F.col("_th").alias("source_th"), F.col("place").alias("source_place"))
        #: The reference block of each anchor.
        self.central = stored(central, f"{self.root}/central")
        met = self.blocks.join(self.central, F.col("anchor") == F.col("_a")).where((F.col("c1") != F.col("_c1")) | (F.col("c2") != F.col("_c2")))
        #: What the other blocks share with it.
        self.factored = stored(factored(met, window), f"{self.root}/factored")

    def _boundaries(self) -> DataFrame:
        """(anchor, c1, c2, mask): windows that cross a factor boundary and start elsewhere too."""
        crossing = self.factored.select("anchor", "c1", "c2", "held", F.inline("rest"))
        key = ["anchor", "bit", "h1", "h2"]
        again = stored(crossing.groupBy(*key).agg(F.sum("held").alias("n")).where("n > 1").drop("n"), f"{self.root}/again")
        bit = F.expr("shiftleft(1L, bit)")
        asked = crossing.join(again, key).groupBy("anchor", "c1", "c2").agg(F.bit_or(bit).alias("open"))
        asked = stored(asked, f"{self.root}/asked")
        own = stored(_window_words(self.blocks.join(asked, ["anchor", "c1", "c2"]), self.window), f"{self.root}/windows")
        same = own.groupBy("anchor", "bit", "own").agg(F.sum("held").alias("n")).where("n > 1").drop("n")
        same = stored(same, f"{self.root}/same")
        return own.join(same, ["anchor", "bit", "own"]).groupBy("anchor", "c1", "c2").agg(F.bit_or(bit).alias("mask"))

    def marks(self) -> DataFrame:
        """(_id, _th, place, low, high, mask): blocks with a repeated window; bit b of mask is the window that starts b words before place, null: all."""
        many = self.blocks.where("held > 1").select("anchor", "c1", "c2", F.expr("shiftleft(shiftleft(1L, high - low + 1) - 1L, low)").alias("mask"))
        inside = self.factored.where("mask <> 0")
        # what a block has from the reference block repeats in both
        of_top = inside.groupBy("anchor").agg(F.bit_or("mask").alias("mask")).join(self.central, F.col("anchor") == F.col("_a")).select("anchor", F.col("_c1").alias("c1"), F.col("_c2").alias("c2"), "mask")
        every = many.unionByName(inside.select("anchor", "c1", "c2", "mask")).unionByName(of_top).unionByName(self._boundaries())
        bits = every.groupBy(F.col("anchor").alias("_a"), F.col("c1").alias("_c1"), F.col("c2").alias("_c2")).agg(F.bit_or("mask").alias("mask"))
        bits = stored(bits, f"{self.root}/bits")
        names = ["_id", "_th", "place", "low", "high", "mask"]
        edges = self.edges.join(bits, (F.col("anchor") == F.col("_a")) & (F.col("c1") == F.col("_c1")) & (F.col("c2") == F.col("_c2"))).select(*names)
        return self.found.where("whole").withColumn("mask", F.lit(None).cast("long")).select(*names).unionByName(edges)

    def factors(self) -> DataFrame:
        """(_id, _th, start, end, source, source_th, source_start), factors of a window or more, as long as they go."""
        # equal blocks of an anchor or of a content come from the first of them
        whole = self.found.where("whole").withColumns({"c1": F.lit(0).cast("long"), "c2": F.lit(0).cast("long")}).unionByName(self.edges)
        first = whole.groupBy(*(F.col(c).alias(f"_{c}") for c in ("anchor", "c1", "c2"))).agg(F.min(F.struct("_id", "_th", "place")).alias("s"))
        copies = whole.join(stored(first, f"{self.root}/first"), (F.col("anchor") == F.col("_anchor")) & (F.col("c1") == F.col("_c1")) & (F.col("c2") == F.col("_c2")))
        copies = copies.where(~F.struct("_id", "_th", "place").eqNullSafe(F.col("s")))
        span = [(F.col("place") - F.col("high")).alias("start"), (F.col("place") - F.col("low") + self.window).alias("end")]
        copies = copies.select("_id", "_th", "place", *span, F.col("s._id").alias("source"), F.col("s._th").alias("source_th"), F.col("s.place").alias("source_place"))
        parts = self.factored.where(F.col("left") + F.col("right") >= self.window).select("anchor", "c1", "c2", "left", "right")
        parts = parts.join(self.blocks.drop("held", "words"), ["anchor", "c1", "c2"]).join(self.central.drop("other"), F.col("anchor") == F.col("_a"))
        span = [(F.col("place") - F.col("left")).alias("start"), (F.col("place") + F.col("right")).alias("end")]
        every = copies.unionByName(parts.select("_id", "_th", "place", *span, "source", "source_th", "source_place"))
        every = every.withColumn("shift", F.col("source_place") - F.col("place")).distinct()
        # neighbours that come from one place run together
        by = Window.partitionBy("_id", "_th", "source", "source_th", "shift").orderBy("start", "end")
        before = F.max("end").over(by.rowsBetween(Window.unboundedPreceding, -1))
        every = every.withColumn("new", F.when(F.col("start") <= before, 0).otherwise(1)).withColumn("run", F.sum("new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
        out = every.groupBy("_id", "_th", "source", "source_th", "shift", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"))
        return out.select("_id", "_th", "start", "end", "source", "source_th", (F.col("start") + F.col("shift")).alias("source_start"))


def _checked(window: int) -> int:
    if not 2 <= window <= 64:
        raise ValueError("window must be 2 to 64 words")
    return window


def factors(docs: DataFrame, window: int = 50) -> DataFrame:
    """(doc_id, start, end, source_id, source_start): the factors of each row of docs, in words, end exclusive.

    A factor is a stretch of at least `window` words that its source has at
    source_start word for word; the source is another place of docs. Factors
    of a row may overlap where they come from different places. Null ids stay
    null; repeated rows have their factors once.
    """
    found = Parse(docs.select("doc_id", "text"), _checked(window)).factors()
    real = lambda c: F.when(F.col(c) != -(1 << 63), F.col(c))
    return found.select(real("_id").alias("doc_id"), "start", "end", real("source").alias("source_id"), "source_start")


def dedup_substrings(docs: DataFrame, window: int = 50) -> DataFrame:
    """docs with text reduced to the words outside repeated windows, joined by single spaces.

    Adds n_words, n_removed and spans, the removed word ranges (end
    exclusive). A window counts as repeated if its words start anywhere else
    in docs as well, the same document included. Null text has no words and
    gives an empty text. Repeated rows are documents that repeat each other,
    so all their windows go; null ids make no difference. Other columns pass
    unchanged; input columns with a result's name give way.
    """
    found = Parse(docs.select("doc_id", "text"), _checked(window)).marks()
    found = found.groupBy(F.col("_id").alias("_fid"), F.col("_th").alias("_fth")).agg(F.collect_set(F.struct("place", "low", "high", "mask")).alias("found"))
    left = docs.select(packed(docs, "text", "n_words", "n_removed", "spans"), *row_key(), F.col("text").alias("_text"))
    rows = left.join(found, (F.col("_id") == F.col("_fid")) & (F.col("_th") == F.col("_fth")), "left").select("_row", "_text", "found")
    schema = rows.select("_row", F.lit("").alias("text"), F.lit(0).cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_removed"), F.array(F.struct(F.lit(0).alias("start"), F.lit(0).alias("end"))).alias("spans")).schema

    def run(parts):
        span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        for part in parts:
            kept, total, gone, spans = [], [], [], []
            for text, marks in zip(part.column("_text").to_pandas(), part.column("found").to_pylist(), strict=True):
                words = words_of(text)
                total.append(len(words))
                if not marks:
                    kept.append(b" ".join(words).decode())
                    gone.append(0)
                    spans.append([])
                    continue
                step = np.zeros(len(words) + 1, np.int32)
                for m in marks:
                    place, mask = m["place"], m["mask"]
                    if mask is None:
                        step[place - m["high"]] += 1
                        step[place - m["low"] + window] -= 1
                    else:
                        for b in range(m["low"], m["high"] + 1):
                            if mask >> b & 1:
                                step[place - b] += 1
                                step[place - b + window] -= 1
                covered = np.cumsum(step[:-1]) > 0
                kept.append(b" ".join([words[i] for i in np.flatnonzero(~covered)]).decode())
                gone.append(int(covered.sum()))
                edge = np.flatnonzero(np.diff(np.concatenate([[False], covered, [False]]).astype(np.int8)))
                spans.append([{"start": int(a), "end": int(b)} for a, b in edge.reshape(-1, 2)])
            arrays = [part.column("_row"), pa.array(kept, pa.string()), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(spans, span)]
            yield pa.RecordBatch.from_arrays(arrays, ["_row", "text", "n_words", "n_removed", "spans"])

    out = rows.mapInArrow(run, schema)
    return with_made(out, docs, {c: F.col(c) for c in ("text", "n_words", "n_removed", "spans")})


def query(spark: SparkSession, docs: DataFrame) -> DataFrame:
    out = dedup_substrings(docs.select("doc_id", "text"), window=35)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))
