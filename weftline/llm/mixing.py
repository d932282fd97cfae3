"""Mixing sources to target weights by Sainte-Laguë apportionment.

A mix is made of blocks of equally many words. Sources get blocks by highest
quotients of their targets, the shards of a source (a bounded number of
words each) by highest quotients of their sizes, and a shard's blocks are
then drawn by a seeded hash.
"""

from __future__ import annotations

from collections import OrderedDict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import numbered, scratch, stored, whole_text

WEIGHTS = (3, 1, 2)
#: What the mix holds of all words, in percent, and how often it takes a word at most.
PERCENT, MOST = 150, 2
#: Words of a block: 64, or a 256th of the smallest target if that is less (one word at least).
BLOCK, BLOCKS_OF_LEAST = 64, 256
#: Words and documents of a shard, about: what one task draws from at a time. A longer document is a shard of its own length.
SHARD = 1 << 22
SEED = 13
_WORD = r"[^\x20\x09-\x0D]+"


def apportion(parties: DataFrame, seats: DataFrame, path: str) -> DataFrame:
    """(grp, party, quota) by Sainte-Laguë: seats (grp, seats) go to the highest of votes / 1, / 3, / 5 and so on.

    parties: (grp, party, votes, most), most being the seats that a party can
    take. Ties go to the smaller party. A party starts with somewhat fewer
    seats than its exact share, the rest go by the quotients that follow; if
    the last quotient taken shows that the start or the number of quotients
    looked at was off, it is done again with more of them.
    """
    total = parties.groupBy("grp").agg(F.sum("votes").alias("_all"))
    p = stored(parties.join(total.join(seats, "grp"), "grp").withColumn("_share", F.coalesce(F.try_divide(F.col("votes") * F.col("seats"), F.col("_all")), F.lit(0.0))), f"{path}/parties")
    spread = 1
    quotient = lambda k: F.col("votes") / (2 * k + 1)
    while True:
        low = F.least(F.col("most"), F.greatest(F.lit(0), F.floor("_share") - spread)).cast("long")
        high = F.least(F.col("most"), F.col("_low") + 2 * spread + 2)
        banded = p.withColumn("_low", low).withColumn("_high", high)
        left = banded.groupBy("grp").agg((F.first("seats") - F.sum("_low")).alias("_left"))
        offers = banded.where("_high > _low").select("grp", "party", "votes", F.explode(F.sequence(F.col("_low"), F.col("_high") - 1)).alias("k")).withColumn("q", quotient(F.col("k")))
        ranks = numbered(offers, f"{path}/offers-{spread}", F.col("grp"), F.desc("q"), F.col("party"), F.col("k"))
        first = ranks.groupBy("grp").agg(F.min("_rank").alias("_first")).join(left, "grp")
        taken = stored(ranks.join(first, "grp").withColumn("_in", F.col("_rank") - F.col("_first") < F.col("_left")), f"{path}/taken-{spread}")
        # the last quotient taken and the first left over, against those that weren't offered
        edge = taken.groupBy("grp").agg(F.min(F.when(F.col("_in"), F.col("q"))).alias("_last"), F.max(F.when(~F.col("_in"), F.col("q"))).alias("_next"), F.count(F.when(F.col("_in"), 1)).alias("_given"), F.first("_left").alias("_left"))
        off = banded.join(edge, "grp").where(
            ((F.col("_high") < F.col("most")) & ((F.col("_given") < F.col("_left")) | (quotient(F.col("_high")) > F.col("_last"))))
            | ((F.col("_low") > 0) & ((F.col("_left") < 0) | (quotient(F.col("_low") - 1) < F.coalesce("_next", F.lit(0.0)))))
        )
        if off.isEmpty():
            won = taken.where("_in").groupBy("grp", "party").agg(F.count(F.lit(1)).alias("_won"))
            out = banded.join(won, ["grp", "party"], "left").select("grp", "party", (F.col("_low") + F.coalesce("_won", F.lit(0))).alias("quota"))
            return stored(out, f"{path}/quotas")
        spread *= 4


def targets(sources: DataFrame, percent: int = PERCENT, most: int = MOST) -> tuple[DataFrame, float]:
    """sources (words, weight) with target, and the sum of the targets.

    Weights share percent of all words; a target stops at `most` times its
    source's words, and what is over is shared again by weight until none is
    above. The driver sees sums only.
    """
    words = sources.agg(F.coalesce(F.sum("words"), F.lit(0))).first()[0]
    full = F.col("words") * most
    # words for each unit of weight; it rises until no further source stops
    level, before = 0.0, None
    while True:
        stops = full <= F.col("weight") * F.lit(level)
        r = sources.agg(F.count(F.when(stops, 1)).alias("n"), F.coalesce(F.sum(F.when(stops, full)), F.lit(0)).alias("full"), F.coalesce(F.sum(F.when(~stops, F.col("weight"))), F.lit(0)).alias("weight")).first()
        if r["n"] == before or not r["weight"]:
            break
        before, level = r["n"], (words * percent / 100 - r["full"]) / r["weight"]
    return sources.withColumn("target", F.least(full.cast("double"), F.col("weight") * F.lit(level)) if r["weight"] else full.cast("double")), words * percent / 100


def _mixed64(x: np.ndarray) -> np.ndarray:
    """A bijective hash of 64-bit numbers: distinct numbers keep distinct hashes."""
    with np.errstate(over="ignore"):
        x = x + np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def drawn(blocks: int, quota: int, seed: int) -> np.ndarray:
    """How often each block of a shard is taken: equally often, and the rest of the quota by the smallest seeded hashes."""
    each, rest = divmod(quota, blocks)
    out = np.full(blocks + 1, each, np.int64)
    out[blocks] = 0
    if rest:
        # the seed is hashed first, so that the blocks of two shards have unrelated numbers
        start = _mixed64(np.array([seed & 0xFFFFFFFFFFFFFFFF], np.uint64))
        with np.errstate(over="ignore"):
            hashes = _mixed64(start + np.arange(blocks, dtype=np.uint64))
        out[np.argpartition(hashes, rest - 1)[:rest]] += 1
    return out


def _spans(first: int, size: int, copies: np.ndarray, block: int) -> list[dict]:
    out: list[dict] = []
    for j in range(first // block, -(-(first + size) // block)):
        n, a, b = int(copies[j]), max(j * block - first, 0), min((j + 1) * block - first, size)
        if out and out[-1]["end"] == a and out[-1]["copies"] == n:
            out[-1]["end"] = b
        elif n:
            out.append({"start": a, "end": b, "copies": n})
    return out


def sized(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """(doc_id, source, size, order) of docs: words of the whole text, and a seeded hash to lay documents out by."""
    order = F.xxhash64(F.lit(seed), F.col("doc_id"), whole_text())
    return docs.select("doc_id", F.col("source").cast("string").alias("source"), F.regexp_count(whole_text(), F.lit(_WORD)).cast("long").alias("size"), order.alias("order"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, percent: int = PERCENT, most: int = MOST, block: int = 0, shard: int = SHARD, seed: int = SEED, spans: bool = False) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken) of every document: how many of its words the mix takes, repeats counted.

    With spans also spans, an array of (start, end, copies) in words: the
    parts of the document that are taken. Sources are weighed in code-point
    order, null last, by weights in turn. A document is taken whole, in part,
    up to `most` times, or not at all, by the blocks that it lies in.

    A null or empty text has size 0 and nothing taken, and a source without
    words the target 0. Ids may be null or repeated: each row is a document of
    its own. Equal rows get the same lot of results in whatever order. An empty
    table gives no row. Columns other than doc_id, source and text are not read.
    """
    spark = docs.sparkSession
    root = scratch(spark)
    rows = stored(sized(docs, seed), f"{root}/sized")
    by_source = rows.groupBy("source").agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("n"))
    ranked = numbered(by_source, f"{root}/sources", F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("grp") % len(weights) + 1).cast("int"))
    sources, mixed = targets(stored(ranked.withColumnRenamed("_rank", "grp").withColumn("weight", weight), f"{root}/weighed"), percent, most)
    sources = stored(sources.withColumn("shards", F.ceil((F.col("words") + F.col("n")) / shard)), f"{root}/targets")
    least = sources.where("target > 0").agg(F.min("target")).first()[0]
    block = block or int(max(1, min(BLOCK, (least or 0) // BLOCKS_OF_LEAST)))

    # a source may hold any share of the rows: its documents are dealt to shards, so no later step gathers by source alone
    known = sources.select(F.col("source").alias("_s"), "grp", F.col("words").alias("source_size"), "target", "shards")
    dealt = rows.join(known, F.col("source").eqNullSafe(F.col("_s"))).withColumn("shard", F.pmod(F.xxhash64(F.lit(seed + 1), "order", "doc_id"), F.col("shards")))
    lined = Window.partitionBy("grp", "shard").orderBy("order", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    laid = stored(dealt.drop("_s", "shards").withColumn("first", F.coalesce(F.sum("size").over(lined), F.lit(0))), f"{root}/laid")

    cut = laid.groupBy("grp", "shard").agg(F.sum("size").alias("words")).where("words > 0")
    cut = stored(cut.withColumn("blocks", F.ceil(F.col("words") / block)), f"{root}/shards")
    caps = cut.groupBy("grp").agg((F.sum("blocks") * most).alias("most"))
    seats = sources.agg(F.lit(0).alias("grp"), F.lit(round(mixed / block)).cast("long").alias("seats"))
    parties = sources.where("target > 0").join(caps, "grp").select(F.lit(0).alias("grp"), F.col("grp").alias("party"), F.col("target").alias("votes"), "most")
    of_source = apportion(parties, seats, f"{root}/by-source").select(F.col("party").alias("grp"), F.col("quota").alias("seats"))
    parties = cut.select("grp", F.col("shard").alias("party"), F.col("words").cast("double").alias("votes"), (F.col("blocks") * most).alias("most"))
    of_shard = apportion(parties, of_source, f"{root}/by-shard").withColumnRenamed("party", "shard")
    quotas = cut.select("grp", "shard", "blocks").join(of_shard, ["grp", "shard"])

    def run(parts):
        known: OrderedDict = OrderedDict()

        def copies(grp: int, shard_: int, blocks: int, quota: int) -> tuple[np.ndarray, np.ndarray]:
            if (grp, shard_) not in known:
                if len(known) >= 4:
                    known.popitem(last=False)
                n = drawn(blocks, quota, int(_mixed64(np.array([(seed << 40) ^ grp], np.uint64))[0]) ^ shard_)
                known[grp, shard_] = n, np.concatenate([[0], np.cumsum(n)])
            return known[grp, shard_]

        for part in parts:
            cols = [part.column(c).to_numpy(zero_copy_only=False) for c in ("grp", "shard", "blocks", "quota", "first", "size")]
            taken, where = np.zeros(part.num_rows, np.int64), [[] for _ in range(part.num_rows)]
            grp, shard_, blocks, quota, first, size = cols
            some = np.flatnonzero((blocks > 0) & (size > 0))
            # rows come by shard, so this is one step for each shard of the batch
            edges = np.flatnonzero((np.diff(grp[some]) != 0) | (np.diff(shard_[some]) != 0)) + 1
            for rows_ in np.split(some, edges) if len(some) else []:
                k = rows_[0]
                n, before = copies(int(grp[k]), int(shard_[k]), int(blocks[k]), int(quota[k]))
                upto = lambda at: block * before[at // block] + n[at // block] * (at % block)  # noqa: B023, E731
                taken[rows_] = upto(first[rows_] + size[rows_]) - upto(first[rows_])
                if spans:
                    for r in rows_:
                        where[r] = _spans(int(first[r]), int(size[r]), n, block)
            out = [part.column(c) for c in ("doc_id", "source", "size", "source_size", "target")] + [pa.array(taken)]
            names = ["doc_id", "source", "size", "source_size", "target", "taken"]
            if spans:
                out, names = [*out, pa.array(where, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("copies", pa.int64())])))], [*names, "spans"]
            yield pa.RecordBatch.from_arrays(out, names)

    asked = laid.join(quotas, ["grp", "shard"], "left").fillna(0, ["blocks", "quota"])
    # both sides by shard, so that the blocks of a shard are drawn in one task, once
    asked = asked.repartition("grp", "shard").sortWithinPartitions("grp", "shard", "first")
    id_type = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, source string, size bigint, source_size bigint, target double, taken bigint"
    return asked.select("doc_id", "source", "size", "source_size", "target", "grp", "shard", "first", "blocks", "quota").mapInArrow(run, schema + (", spans array<struct<start: bigint, end: bigint, copies: bigint>>" if spans else ""))


def query(spark: SparkSession, docs: DataFrame) -> DataFrame:
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")
