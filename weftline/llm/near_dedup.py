"""Near-duplicate documents: circulant MinHash, banding, exact Jaccard verification.

Two permutations make every signature coordinate. The first scatters a
shingle over a universe of 2**20 places, the second, shifted circularly by k,
gives the value of the place for coordinate k. Documents with equal sets of
shingles are one node from the start. Nodes that share a band meet in a
bucket, and every pair of a bucket is verified on the full sets.

Buckets with the same members in several bands are gone through once, large
ones in blocks of bounded size that share the bucket's centre. What is then one
component needs no more comparing; only the others of the bucket meet all its
members. Inside a block all intersections come from one product of the
incidence matrix, and what leaves it is a spanning forest of the verified
links, so that no row is made for a pair.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from .bpe import Remembered
from .common import discard, packed, row_key, scratch, stored, with_made

#: Coordinates of a band, and the chance at the threshold that a pair shares no band.
ROWS, MISS = 4, 1e-5
UNIVERSE = 1 << 20
#: Members of a bucket that a block takes, and shingles that they may hold together; two blocks meet at a time.
BLOCK, BLOCK_SHINGLES = 512, 4_000_000
#: Shingles that one step of a product takes.
COLUMNS = 4096


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def bands_for(percent: int) -> int:
    """How many bands a threshold needs: 16 at 85 %, 22 at 80 %."""
    share = min(percent, 99) / 100
    return max(1, math.ceil(math.log(MISS) / math.log(1 - share**ROWS)))


@lru_cache(maxsize=2)
def _windows(coordinates: int) -> np.ndarray:
    """Row i: the second permutation at place i under each of the circular shifts."""
    second = np.random.default_rng(20_240_229).permutation(UNIVERSE).astype(np.int32)
    return sliding_window_view(np.concatenate([second, second[: coordinates - 1]]), coordinates)


_words: Remembered | None = None


def shingles(text: str | None, width: int) -> np.ndarray:
    """Hashes of the distinct shingles of a whole text, ascending.

    A-Z are lower-cased; words end at ASCII white space. Fewer words than the
    width make one shingle, no words none.
    """
    global _words
    if _words is None:
        _words = Remembered(xxhash.xxh3_64_intdigest, 500_000)
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    width = min(width, len(h))
    out = np.full(len(h) - width + 1, width, np.uint64)
    for i in range(width):
        out = _mix(out + h[i : i + len(out)])
    return np.unique(out)


def signature(codes: np.ndarray, coordinates: int) -> np.ndarray:
    places = (_mix(codes ^ np.uint64(0xA0761D6478BD642F)) % np.uint64(UNIVERSE)).astype(np.int64)
    windows = _windows(coordinates)
    out = np.full(coordinates, UNIVERSE, np.int32)
    for at in range(0, len(places), 8192):
        np.minimum(out, windows[places[at : at + 8192]].min(axis=0), out=out)
    return out


def bands(sig: np.ndarray) -> np.ndarray:
    parts = sig.astype(np.uint64).reshape(-1, ROWS)
    out = np.arange(len(parts), dtype=np.uint64)
    for i in range(ROWS):
        out = _mix(out + parts[:, i])
    return out.view(np.int64)


SKETCH = "_id bigint, _th bigint, doc_id bigint, n int, f1 bigint, f2 bigint, bands array<bigint>"


def sketches(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """Of each row: its key, the size and a 128-bit fingerprint of its set, and its band hashes."""
    coordinates = ROWS * bands_for(percent)

    def run(parts):
        for part in parts:
            n, f1, f2, band = [], [], [], []
            for text in part.column("text").to_pandas():
                s = shingles(text, width)
                n.append(len(s))
                f1.append(int(_mix(s).sum(dtype=np.uint64).astype(np.int64)))
                f2.append(int(_mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64).astype(np.int64)))
                band.append(bands(signature(s, coordinates)) if len(s) else np.empty(0, np.int64))
            cols = [pa.array(n, pa.int32()), pa.array(f1, pa.int64()), pa.array(f2, pa.int64()), pa.array(band, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([part.column("_id"), part.column("_th"), part.column("doc_id"), *cols], ["_id", "_th", "doc_id", "n", "f1", "f2", "bands"])

    return docs.select(*row_key(), F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SKETCH)


def components(edges: DataFrame, root: str) -> DataFrame:
    """(node, label) of every node of edges (a, b): the smallest node that can be reached.

    Each round takes the least label among neighbours, then the label of the
    label, so chains halve; every round is written, none depends on an executor.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = stored(both.distinct(), f"{root}/edges")
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label")), f"{root}/0")
    rounds = 0
    while True:
        rounds += 1
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        new = labels.join(near, "node").select("node", "label", F.least("label", "near").alias("new"))
        far = labels.select(F.col("node").alias("new"), F.col("label").alias("far"))
        new = stored(new.join(far, "new").select("node", "label", F.least("new", "far").alias("new")), f"{root}/{rounds}")
        labels = new.select("node", F.col("new").alias("label"))
        # the round before is read by nothing else
        discard(both.sparkSession, f"{root}/{rounds - 1}")
        if new.where(F.col("label") != F.col("new")).isEmpty():
            return labels


def _blocks(held: Column, shingles: Column) -> Column:
    """How many blocks so many members with so many shingles make."""
    return F.greatest(F.ceil(held / BLOCK), F.ceil(shingles / BLOCK_SHINGLES))


def buckets(nodes: DataFrame) -> DataFrame:
    """(band, hash, parts, centre, node, n): members of each bucket of two or more, and how many blocks they make.

    Of buckets with the same members, told by their number and 128 bits, the one of the first band is left.
    """
    rows = nodes.select("node", "n", F.posexplode("bands").alias("band", "hash"))
    x = lambda salt: F.bit_xor(F.xxhash64("node", F.lit(salt)))
    shared = rows.groupBy("band", "hash").agg(F.count(F.lit(1)).alias("held"), F.sum("n").alias("shingles"), F.min("node").alias("centre"), x(1).alias("x1"), x(2).alias("x2")).where("held > 1")
    shared = shared.groupBy("held", "x1", "x2").agg(F.min(F.struct("band", "hash", "centre", "shingles")).alias("b"))
    parts = _blocks(F.col("held"), F.col("b.shingles"))
    return rows.join(shared.select("b.band", "b.hash", "b.centre", parts.alias("parts")), ["band", "hash"])


def _dealt(parts: str) -> Column:
    return F.pmod(F.xxhash64("node"), F.col(parts))


def first_meetings(members: DataFrame) -> DataFrame:
    """(band, hash, i, j, node): each member in one block, and the bucket's centre in every block (in its own twice)."""
    own = members.select("band", "hash", _dealt("parts").alias("i"), "node")
    many = members.where((F.col("parts") > 1) & (F.col("node") == F.col("centre")))
    centre = many.select("band", "hash", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("i"), "node")
    return own.unionByName(centre).select("band", "hash", "i", F.lit(-1).cast("long").alias("j"), "node")


def later_meetings(members: DataFrame, labels: DataFrame) -> DataFrame:
    """(band, hash, i, j, node) for what the first meetings leave open in buckets of several blocks.

    Members of a bucket's largest component so far are settled among each
    other. The rest, in blocks of their own, meet all members block by block.
    """
    many = members.where("parts > 1").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    count = many.groupBy("band", "hash", "label").agg(F.count(F.lit(1)).alias("many"), F.sum("n").alias("size"))
    top = count.groupBy("band", "hash").agg(F.max(F.struct("many", "label", "size")).alias("top"), F.sum("many").alias("held"), F.sum("size").alias("shingles"))
    top = top.where("held > top.many").select("band", "hash", F.col("top.label").alias("top"), _blocks(F.col("held") - F.col("top.many"), F.col("shingles") - F.col("top.size")).alias("open"))
    many = many.join(top, ["band", "hash"])
    all_ = many.select("band", "hash", F.explode(F.sequence(F.lit(0), F.col("open") - 1)).alias("i"), _dealt("parts").alias("j"), "node")
    rest = many.where("label <> top").select("band", "hash", _dealt("open").alias("i"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("j"), "node")
    return all_.unionByName(rest)


def intersections(values: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Sizes of the intersections of n sets given as (value, owner) pairs without repeats."""
    _, code, count = np.unique(values, return_inverse=True, return_counts=True)
    # what only one set holds is in no intersection
    shared = count > 1
    row, column = owner[shared[code]], (np.cumsum(shared) - 1)[code[shared[code]]]
    order = np.argsort(column, kind="stable")
    row, column, width = row[order], column[order], int(shared.sum())
    # whole numbers: floats of 32 bits would be off beyond 2**24 common values, and 100 times such a count earlier
    out = np.zeros((n, n), np.int64)
    for at in range(0, width, COLUMNS):
        lo, hi = np.searchsorted(column, [at, at + COLUMNS])
        part = np.zeros((n, min(COLUMNS, width - at)), np.float32)
        part[row[lo:hi], column[lo:hi] - at] = 1
        out += (part @ part.T).astype(np.int64)
    return out


def forest(linked: np.ndarray) -> np.ndarray:
    """For each row of a symmetric link matrix the least row that it reaches."""
    label = np.arange(len(linked))
    while True:
        new = np.minimum(label, np.where(linked, label[None], len(linked)).min(axis=1, initial=len(linked)))
        if (new == label).all():
            return label
        label = new[new]


def _linked(meetings: DataFrame, sets_of: DataFrame, percent: int) -> DataFrame:
    """(a, b): edges that join what is linked by 100 * intersection >= percent * union in a meeting."""

    def meet(block: pa.Table) -> pa.Table:
        block = block.combine_chunks()
        node, first = np.unique(block.column("node").to_numpy(), return_index=True)
        own = block.column("s").chunk(0).take(pa.array(first))
        size = np.diff(own.offsets.to_numpy())
        both = intersections(own.flatten().to_numpy(), np.repeat(np.arange(len(node)), size), len(node))
        linked = 100 * both >= percent * (size[:, None] + size[None] - both)
        label = forest(linked)
        far = label != np.arange(len(node))
        return pa.table({"a": node[label[far]], "b": node[far]})

    return meetings.join(sets_of, "node").groupBy("band", "hash", "i", "j").applyInArrow(meet, "a bigint, b bigint").distinct()


def bucket_labels(nodes: DataFrame, docs: DataFrame, members: DataFrame, width: int, percent: int, root: str) -> DataFrame:
    """(node, label) of all nodes with a link: the smallest node that links inside buckets reach.

    members: (node, _id, _th) of one row for each node. Buckets of several
    blocks are settled in two goes: blocks and centres first, then what is
    still in different components. A large group of copies is one component
    after the first, so its rows grow with its members.
    """
    rows = stored(buckets(nodes), f"{root}/buckets")
    asked = rows.select("node").distinct().join(members, "node").select("node", F.col("_id").alias("_aid"), F.col("_th").alias("_ath"))
    texts = docs.select(*row_key(), "text").join(asked, (F.col("_id") == F.col("_aid")) & (F.col("_th") == F.col("_ath")))

    def sets(parts):
        for part in parts:
            got = [shingles(t, width).view(np.int64) for t in part.column("text").to_pandas()]
            yield pa.RecordBatch.from_arrays([part.column("node"), pa.array(got, pa.list_(pa.int64()))], ["node", "s"])

    # rows that are equal in id and text share a key: one of them serves
    sets_of = stored(texts.dropDuplicates(["node"]).select("node", "text").mapInArrow(sets, "node bigint, s array<bigint>"), f"{root}/sets")

    links = stored(_linked(first_meetings(rows), sets_of, percent), f"{root}/links")
    labels = components(links, f"{root}/components")
    if rows.where("parts > 1").isEmpty():
        return labels
    meetings = stored(later_meetings(rows, labels), f"{root}/meetings")
    if meetings.isEmpty():
        return labels
    more = _linked(meetings, sets_of, percent)
    for c in ("a", "b"):
        more = more.join(labels.select(F.col("node").alias(c), F.col("label").alias("_l")), c, "left").withColumn(c, F.coalesce("_l", c)).drop("_l")
    more = stored(more.where("a <> b").distinct(), f"{root}/more")
    above = components(more, f"{root}/above")
    up = labels.join(above.select(F.col("node").alias("label"), F.col("label").alias("_up")), "label", "left").select("node", F.coalesce("_up", "label").alias("label"))
    return stored(up.unionByName(above.join(labels, "node", "left_anti")), f"{root}/labels")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """Of each row of docs: doc_id, its key, n_shingles and component_id.

    component_id is the smallest doc_id that links reach, itself included.
    Rows without a word are linked with nothing. Rows with one doc_id but
    different texts are documents of their own. Rows with a null doc_id take
    part; their component_id is null only if nothing they reach has an id.
    """
    spark = docs.sparkSession
    root = scratch(spark)
    rows = stored(sketches(docs, width, percent), f"{root}/sketches")
    classes = rows.where("n > 0").groupBy("n", "f1", "f2").agg(F.min("doc_id").alias("least"), F.first("bands").alias("bands"), F.min(F.struct("_id", "_th")).alias("row"))
    # a class is named by its smallest doc_id, and by a number above any id if it has none or another class has it too
    turn = F.row_number().over(Window.partitionBy("least", F.when(F.col("least").isNull(), F.col("f1"))).orderBy("n", "f1", "f2"))
    made = F.lit(1 << 62) + F.pmod(F.xxhash64("n", "f1", "f2"), F.lit(1 << 61))
    classes = classes.withColumn("node", F.when((turn == 1) & F.col("least").isNotNull(), F.col("least")).otherwise(made))
    classes = stored(classes, f"{root}/classes")
    labels = bucket_labels(classes.select("node", "n", "bands"), docs, classes.select("node", "row._id", "row._th"), width, percent, f"{root}/pairs")

    linked = classes.select("node", "n", "f1", "f2", "least").join(labels, "node", "left")
    linked = linked.withColumn("label", F.coalesce("label", "node"))
    least = linked.groupBy("label").agg(F.min("least").alias("component"))
    # written first: both sides of the join are then plain shuffles, whose large parts Spark can split
    linked = stored(linked.join(least, "label").select("n", "f1", "f2", "component"), f"{root}/linked")
    out = rows.join(linked, ["n", "f1", "f2"], "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", "_id", "_th", F.col("n").cast("long").alias("n_shingles"), component.alias("component_id"))


def keep_one(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs that are the smallest doc_id of their component, all columns unchanged.

    Rows without a doc_id stay unless their component has a row with one.
    """
    found = near_duplicates(docs.select("doc_id", "text"), width, percent)
    gone = found.where(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("_id").alias("_gid"), F.col("_th").alias("_gth")).distinct()
    left = docs.select(packed(docs), *row_key())
    out = left.join(gone, (F.col("_id") == F.col("_gid")) & (F.col("_th") == F.col("_gth")), "left_anti")
    return with_made(out, docs, {})


def kept() -> Column:
    return F.col("doc_id").eqNullSafe(F.col("component_id"))


def query(spark: SparkSession, docs: DataFrame) -> DataFrame:
    out = near_duplicates(docs.select("doc_id", "text"), width=3, percent=85)
    return out.select("doc_id", "n_shingles", "component_id", kept().alias("kept"))
