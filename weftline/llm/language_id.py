"""Language identification by rank-order n-gram profiles.

A language's profile is the ranking of its most frequent n-grams (one to
three letters, word borders included). A document's own ranking is compared
with each profile: every n-gram counts by how many places it is out, one that
a profile lacks by the largest number. The nearest profile wins.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import numbered, scratch, stored

PROFILE = 400
#: Labelled documents of a language that a profile is learned from (about so many: chosen by hash).
SAMPLED = 500
#: Languages whose profiles are in the driver and in each worker at a time: 1,000 * PROFILE codes of 8 bytes, 3.2 MB.
#: Of more languages, one slice after another judges the documents, and the least distance is carried on.
LANGUAGES = 1000
_OTHER = regex.compile(r"\P{L}+")
_EDGE = ord("_")


def ngrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the n-grams of a whole text, ascending, and their counts. No letter: none.

    A code packs the code points, 21 bits each, so codes sort as the strings do
    among n-grams of one length.
    """
    words = _OTHER.sub("_", text.lower()).strip("_")
    if not words:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    a = np.frombuffer(f"_{words}_".encode("utf-32-le"), "<u4").astype(np.int64)
    two = a[:-1] << 21 | a[1:]
    three = (two[:-1] << 21 | a[2:])[a[1:-1] != _EDGE]
    return np.unique(np.concatenate([a[a != _EDGE], two, three]), return_counts=True)


def ranked(codes: np.ndarray, counts: np.ndarray, most: int = PROFILE) -> np.ndarray:
    """The most frequent codes first, equal counts by code."""
    return codes[np.argsort(-counts, kind="stable")[:most]]


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


class Profiles:
    """Profiles as a table (lang, place, code, at): at numbers the languages by name, from 0."""

    def __init__(self, rows: DataFrame, languages: int, slice_of: int = LANGUAGES):
        self.rows, self.languages, self.slice_of = rows, languages, slice_of

    def __bool__(self) -> bool:
        return self.languages > 0

    def slices(self) -> Iterator[dict[str, np.ndarray]]:
        """The profiles by name, slice_of languages at a time."""
        for low in range(0, self.languages, self.slice_of):
            out: dict[str, list] = {}
            for r in self.rows.where((F.col("at") >= low) & (F.col("at") < low + self.slice_of)).orderBy("at", "place").collect():
                out.setdefault(r["lang"], []).append(r["code"])
            yield {k: np.array(v, np.int64) for k, v in out.items()}


def learn(docs: DataFrame, sampled: int = SAMPLED, most: int = PROFILE, slice_of: int = LANGUAGES) -> Profiles:
    """Profiles from the labelled documents that aren't held out.

    About `sampled` documents of each language are read, those with the
    smallest hashes of their ids and texts. Of any number of languages the
    profiles are one table; slice_of of them are in the driver at a time.
    """
    spark = docs.sparkSession
    known = docs.where(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang", "text")
    share = known.groupBy("lang").agg((F.lit(float(sampled)) / F.count(F.lit(1))).alias("share"))
    draw = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1_000_003)) / F.lit(1_000_003.0)
    root = scratch(spark)
    # written first, so that its size is known: the texts stay where they are as long as it can be broadcast
    share = stored(share, f"{root}/share")
    picked = known.join(share, "lang").where(draw < F.col("share")).select("lang", "text")

    def count(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for lang, text in zip(part["lang"], part["text"], strict=True):
                codes, counts = ngrams(text)
                yield pd.DataFrame({"lang": lang, "code": codes, "n": counts})

    totals = picked.mapInPandas(count, "lang string, code bigint, n bigint").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "code"))
    top = stored(totals.withColumn("place", place).where(F.col("place") <= most).select("lang", "place", "code"), f"{root}/top")
    names = numbered(top.select("lang").distinct(), f"{root}/names", F.col("lang")).withColumnRenamed("_rank", "at")
    rows = stored(top.join(names, "lang"), f"{root}/profiles")
    last = rows.agg(F.max("at")).first()[0]
    return Profiles(rows, 0 if last is None else last + 1, slice_of)


def readable(docs: DataFrame) -> DataFrame:
    """The rows whose text has a letter: those that ngrams() finds something in."""

    def run(parts):
        import pyarrow as pa

        for part in parts:
            yield part.filter(pa.array([bool(_OTHER.sub("", t or "")) for t in part.column("text").to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


class Judge:
    def __init__(self, profiles: dict[str, np.ndarray], most: int = PROFILE):
        self.langs, self.most = sorted(profiles), most
        self.sorted, self.place = [], []
        for lang in self.langs:
            order = np.argsort(profiles[lang])
            self.sorted.append(profiles[lang][order])
            self.place.append(order)

    def __call__(self, text: str | None, best: str = "und", least: int | None = None) -> tuple[str, int | None, float]:
        """The nearest language, its distance and score, after the best of those judged so far."""
        own = ranked(*ngrams(text or ""), self.most)
        if not len(own) or not self.langs:
            return "und", None, 0.0
        mine = np.arange(len(own))
        for lang, codes, place in zip(self.langs, self.sorted, self.place, strict=True):
            at = np.minimum(np.searchsorted(codes, own), len(codes) - 1)
            out = int(np.where(codes[at] == own, np.abs(place[at] - mine), self.most).sum())
            if least is None or out < least:
                best, least = lang, out
        return best, least, 1.0 - least / (self.most * len(own))


def predict(docs: DataFrame, profiles: Profiles, most: int = PROFILE) -> DataFrame:
    """docs with lang_pred and score, from the whole text alone.

    `und` with score 0 for a null text, one without a letter, or where no
    profile was learned. Equal distances go to the language whose name sorts
    first. An input column named lang_pred or score gives way.
    """
    docs = docs.drop("lang_pred", "score")
    schema = docs.select("*", F.lit("").alias("lang_pred"), F.lit(0.0).alias("score")).schema
    carried = "_least"
    while carried in docs.columns:
        carried += "_"
    out = docs
    for k, part_of in enumerate(profiles.slices() if profiles else [{}]):
        out = _judged(out, schema.add(carried, "long") if not k else out.schema, part_of, carried, most, k > 0)
    return out.drop(carried)


def _judged(docs: DataFrame, schema, profiles: dict[str, np.ndarray], carried: str, most: int, again: bool) -> DataFrame:
    def run(parts):
        import pyarrow as pa

        judge = Judge(profiles, most)
        for part in parts:
            texts = part.column("text").to_pandas()
            if again:
                before = zip(part.column("lang_pred").to_pylist(), part.column(carried).to_pylist(), strict=True)
                found = [judge(t, *b) for t, b in zip(texts, before, strict=True)]
                part = part.drop_columns(["lang_pred", "score", carried])
            else:
                found = [judge(t) for t in texts]
            made = [pa.array([f[0] for f in found], pa.string()), pa.array([f[2] for f in found], pa.float64()), pa.array([f[1] for f in found], pa.int64())]
            yield pa.RecordBatch.from_arrays([*part.columns, *made], [*part.schema.names, "lang_pred", "score", carried])

    return docs.mapInArrow(run, schema)


def query(spark: SparkSession, docs: DataFrame) -> DataFrame:
    out = predict(docs.select("doc_id", "text"), learn(docs))
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
