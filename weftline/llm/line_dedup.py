"""Line dedup over levelled sorted runs of line hashes (DataFrame functions only).

The index is a list of levels. Each run of a level is a table of
``(h, n, last)``, bucketed and sorted by ``h``: a line hash, in how many
documents it was seen, and the largest doc_id among them. A batch
merge-anti-joins the runs, bucket by bucket and without a shuffle, which drops
every line that a run has already settled (seen often enough, at a doc_id at
least as large), and the rest becomes a run of level 0. Once a level holds
``fanout`` runs they are merged into one run of the next. Batches come from the
largest ids down, so a run settles its lines for all batches after it.

Texts are split and hashed once: the hashed lines are written, counted by
batch, and read again to tell which lines of which document go.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, UPPER, WHITE, discard, packed, row_key, scratch, settings, stored, whole_text, with_made

#: Batches that there are at least, bytes of text of a batch and of a bucket of the runs, and ranges of ids that batches are made of.
BATCHES, BATCH_BYTES, BUCKET_BYTES, CUTS = 4, 1 << 40, 1 << 28, 1000


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(WHITE)), UPPER, LOWER)


def lines_of(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _hash(line: Column, min_chars: int) -> Column:
    """128 bits of the key as hex, null for a short key."""
    return F.when(F.length(line_key(line)) >= min_chars, F.md5(line_key(line)))


def hashed_lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """(_id, _th, pos, h) of each line of docs that is long enough."""
    hashes = F.transform(lines_of(whole_text()), lambda x: F.unhex(_hash(x, min_chars)))
    return docs.select(*row_key(), F.posexplode(hashes).alias("pos", "h")).where("h is not null")


def line_stats(lines: DataFrame, *by: Column) -> DataFrame:
    """(by, h, n, last) over the distinct documents of hashed lines; a document is a doc_id, whatever number of rows it has."""
    return lines.select("h", "_id").distinct().groupBy(*by, "h").agg(F.count(F.lit(1)).alias("n"), F.max("_id").alias("last"))


class LineRuns:
    """The index: absorb() batches of hashed lines, then frequent() for the lines to drop.

    All rows of one doc_id belong in one batch.
    """

    def __init__(self, spark: SparkSession, root: str, min_docs: int = 3, fanout: int = 2, buckets: int = 8):
        self.spark, self.root, self.buckets = spark, root, buckets
        self.min_docs, self.fanout = min_docs, fanout
        self.levels: list[list[DataFrame]] = []
        self._tables: list[str] = []

    def bucketed(self, stats: DataFrame, *by: str) -> DataFrame:
        """stats as a table in sorted buckets, whose scans need neither a shuffle nor a sort."""
        self._tables.append(f"weftline_{self.root.rsplit('-', 1)[-1]}_{len(self._tables)}")
        with _in_order(self.spark):
            out = stats.write.bucketBy(self.buckets, "h").sortBy("h").option("path", f"{self.root}/{self._tables[-1]}")
            (out.partitionBy(*by) if by else out).saveAsTable(self._tables[-1], format="parquet")
        return self.spark.table(self._tables[-1])

    def _add(self, level: int, run: DataFrame) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(self.bucketed(run))
        if len(self.levels[level]) >= self.fanout:
            self._add(level + 1, self._merged(self.levels[level]))
            self.levels[level] = []

    @staticmethod
    def _merged(runs: list[DataFrame]) -> DataFrame:
        """Two by two, bucket by bucket. A union would be shorter, but Spark 4.1 takes one of bucketed scans to be
        partitioned by h, which it isn't, and aggregates it in parts."""

        def pair(a: DataFrame, b: DataFrame) -> DataFrame:
            b = b.select(F.col("h").alias("_h"), F.col("n").alias("_n"), F.col("last").alias("_last"))
            met = a.join(b.hint("merge"), F.col("h") == F.col("_h"), "full")
            total = F.coalesce("n", F.lit(0)) + F.coalesce("_n", F.lit(0))
            return met.select(F.coalesce("h", "_h").alias("h"), total.alias("n"), F.greatest("last", "_last").alias("last"))

        return reduce(pair, runs)

    def all_runs(self) -> list[DataFrame]:
        return [run for level in self.levels for run in level]

    def absorb(self, lines: DataFrame) -> None:
        """Take in a batch of hashed lines."""
        self.absorb_stats(line_stats(lines).repartition(self.buckets, "h"))

    def absorb_stats(self, new: DataFrame) -> None:
        """Take in a batch of (h, n, last)."""
        for run in self.all_runs():
            known = run.where(F.col("n") >= self.min_docs).select(F.col("h").alias("_h"), F.col("last").alias("_last"))
            new = new.join(known.hint("merge"), (F.col("h") == F.col("_h")) & (F.col("last") <= F.col("_last")), "left_anti")
        self._add(0, new)

    def frequent(self) -> DataFrame:
        runs = self.all_runs()
        if not runs:
            return self.spark.createDataFrame([], "h binary, n bigint, last bigint")
        return self._merged(runs).where(F.col("n") >= self.min_docs)

    def drop(self) -> None:
        """Remove the runs, once what frequent() returned is written."""
        for name in self._tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        discard(self.spark, *[f"{self.root}/{name}" for name in self._tables])
        self._tables, self.levels = [], []


def _in_order(spark: SparkSession):
    """Scans of buckets that are one sorted file each count as sorted."""
    return settings(spark, spark_sql_legacy_bucketedTableScan_outputOrdering="true", spark_sql_classic_shuffleDependency_fileCleanup_enabled="true")


def batch_of(cuts: list[int]) -> Column:
    """The number of the range of ids, 0 for the largest ids; cuts ascend, and an id equal to a cut is below it."""
    return F.lit(0) if not cuts else sum((F.when(F.col("_id") <= c, 1).otherwise(0) for c in cuts[1:]), F.when(F.col("_id") <= cuts[0], 1).otherwise(0))


def dedup_lines(docs: DataFrame, min_docs: int = 3, min_chars: int = 20, n_batches: int = 0, fanout: int = 2) -> DataFrame:
    """docs with text reduced to the kept lines, plus n_lines and n_dropped.

    A line whose key has min_chars code points and occurs in min_docs
    documents goes, except in the largest doc_id that holds it. Null or empty
    text is one empty line, kept as an empty text. Rows of one doc_id count as
    one document; null ids together are one document, smaller than any other.
    Identical rows are each returned. Columns besides text pass unchanged; an
    input column named n_lines or n_dropped gives way to the result's.

    Batches are ranges of doc_id of BATCH_BYTES of text, or n_batches of them;
    BATCHES at least, so that the runs settle lines on small inputs too.

    The runs are bucketed Parquet tables in the session's current catalog,
    which has to take such tables, under names of their own; they are gone when
    this returns or fails.
    """
    spark = docs.sparkSession
    root = scratch(spark)
    lines = stored(hashed_lines(docs, min_chars), f"{root}/lines")
    size = docs.agg(F.sum(F.octet_length("text")).alias("bytes"), F.expr(f"percentile_approx(doc_id, array({', '.join(f'{i / CUTS:.6f}' for i in range(1, CUTS))}))").alias("cuts")).first()
    held, cuts = size["bytes"] or 0, size["cuts"] or []
    n = min(n_batches or max(BATCHES, -(-held // BATCH_BYTES)), CUTS)
    cuts = sorted({cuts[CUTS * i // n - 1] for i in range(1, n)}) if cuts else []
    index = LineRuns(spark, root, min_docs, fanout, buckets=min(max(8, -(-held // BUCKET_BYTES)), 20_000))
    try:
        fresh = index.bucketed(line_stats(lines, batch_of(cuts).alias("batch")).repartition(index.buckets, "h"), "batch")
        for k in range(len(cuts) + 1):
            # largest ids first
            index.absorb_stats(fresh.where(F.col("batch") == k).select("h", "n", "last"))
        # written first: both sides of the join below are then plain shuffles, whose large parts Spark can split
        with _in_order(spark):
            hot = stored(index.frequent().select("h", "last"), f"{root}/frequent")
    finally:
        # also when a batch fails: the runs are tables of the session's catalog
        index.drop()

    gone = lines.join(hot, lines["h"] == hot["h"]).where(F.col("_id") != F.col("last"))
    gone = gone.groupBy(F.col("_id").alias("_gid"), F.col("_th").alias("_gth")).agg(F.collect_set("pos").alias("_gone"))

    # the lines are made below the join: inside the lambda above it they would be split anew for each line
    left = docs.select(packed(docs, "text", "n_lines", "n_dropped"), *row_key(), lines_of(whole_text()).alias("_lines"))
    out = left.join(gone, (F.col("_id") == F.col("_gid")) & (F.col("_th") == F.col("_gth")), "left")
    kept = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.col("_gone"))
    text = F.when(F.col("_gone").isNull(), F.array_join("_lines", "\n")).otherwise(F.array_join(F.transform(kept, lambda i: F.get(F.col("_lines"), i)), "\n"))
    made = {"text": text, "n_lines": F.size("_lines").cast("long"), "n_dropped": F.coalesce(F.size("_gone"), F.lit(0)).cast("long")}
    return with_made(out, docs, made)


def query(spark: SparkSession, docs: DataFrame) -> DataFrame:
    out = dedup_lines(docs.select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


SQL = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
k AS (SELECT *, translate(trim(line, chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
hot AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 20
        GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
j AS (SELECT k.doc_id, k.pos, k.line, hot.key IS NOT NULL AND k.doc_id <> hot.last AS gone
      FROM k LEFT JOIN hot ON k.key = hot.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM j GROUP BY doc_id
"""
