"""What the operators of this subpackage share: tables, scratch space, row keys."""

from __future__ import annotations

import contextlib
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of every contract here: space, and tab to carriage return.
WHITE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_own_scratch: list[str] = []
_used: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """A fresh folder below spark.checkpoint.dir, which every executor sees.

    Only where that setting is missing and Spark runs in one process (tests),
    a temporary folder takes its place; a cluster without the setting is an
    error. release() removes what was made.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if not _own_scratch:
            _own_scratch.append("file://" + tempfile.mkdtemp(prefix="weftline-"))
        root = _own_scratch[0]
    _used.append(f"{root.rstrip('/')}/weftline-{uuid.uuid4().hex}")
    return _used[-1]


def discard(spark: SparkSession, *paths: str) -> None:
    """Remove written tables that nothing reads any more."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for path in paths:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(conf).delete(at, True)


def release(spark: SparkSession) -> None:
    """Remove all intermediate tables of this session's operators. DataFrames that they returned end with it."""
    discard(spark, *_used)
    _used.clear()


@contextlib.contextmanager
def settings(spark: SparkSession, **conf: str):
    """Session settings for a block; '_' in a name stands for '.'. They are put back."""
    names = {k.replace("_", "."): v for k, v in conf.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def stored(df: DataFrame, path: str) -> DataFrame:
    """Write df as Parquet and read it again.

    Cuts the lineage with a table that outlives any executor. The shuffle
    files of the write are removed as soon as it ends, so that the steps of
    one operator don't add up on disk.
    """
    spark = df.sparkSession
    # smaller batches than usual: a row may hold a long text or a large set
    with settings(spark, spark_sql_classic_shuffleDependency_fileCleanup_enabled="true", spark_sql_execution_arrow_maxRecordsPerBatch="2000"):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, path: str, *order: Column) -> DataFrame:
    """df with _rank, from 0 in the given order over all its rows.

    Rows are sorted by range; a row's rank is its place in its range and the
    rows of the ranges before, of which the driver has one number each. No
    task orders everything.
    """
    rows = stored(df.orderBy(*order).withColumn("_m", F.monotonically_increasing_id()), path)
    counts = rows.groupBy(F.shiftright("_m", 33).alias("p")).count().orderBy("p").collect()
    before, starts = 0, []
    for r in counts:
        starts.append((r["p"], before))
        before += r["count"]
    # one row for each range of the sort
    offsets = F.broadcast(df.sparkSession.createDataFrame(starts, "_p bigint, _before bigint"))
    inside = F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))
    return rows.withColumn("_p", F.shiftright("_m", 33)).join(offsets, "_p").withColumn("_rank", F.col("_before") + inside).drop("_p", "_m", "_before")


def sliced(parts, rows: int = 500):
    """The Arrow batches in slices, for work that holds several copies of what a row has."""
    for part in parts:
        for at in range(0, part.num_rows, rows):
            yield part.slice(at, rows)


def whole_text(text: str | Column = "text") -> Column:
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def row_key(doc_id: str = "doc_id", text: str = "text") -> list[Column]:
    """Columns that tell rows apart although doc_id may be null or repeated.

    Rows with the same id and the same text get the same decisions, so they
    may share a key. The smallest number stands for a null id.
    """
    return [F.coalesce(F.col(doc_id).cast("long"), F.lit(-(1 << 63))).alias("_id"), F.xxhash64(whole_text(text)).alias("_th")]


def packed(docs: DataFrame, *without: str) -> Column:
    """The columns of docs that pass through, as one struct, so that no working column can clash with them."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in without], F.lit(True).alias("_")).alias("_row")


def with_made(out: DataFrame, docs: DataFrame, made: dict[str, Column]) -> DataFrame:
    """The columns of docs in their order, then those of made that are new; made wins over a column of its name."""
    cols = [made[c].alias(c) if c in made else F.col("_row").getField(c).alias(c) for c in docs.columns]
    return out.select(*cols, *[v.alias(k) for k, v in made.items() if k not in docs.columns])
