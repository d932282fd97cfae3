"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """A fresh folder below spark.checkpoint.dir. Only where that isn't set and Spark runs in one process, a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if not _own:
            _own.append("file://" + tempfile.mkdtemp(prefix="weftline-"))
        root = _own[0]
    return f"{root.rstrip('/')}/weftline-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """df as a table that outlives any executor: computed once, where checkpoint() computes twice."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffled(df: DataFrame) -> DataFrame:
    """df as the side of a join that sorts both: Spark broadcasts by the size of files, and small ones may hold millions of rows."""
    return df.hint("merge")


class Buckets:
    """A table in buckets by some columns that grows by appends: what joins or groups by those shuffles none of it.

    The session's catalog holds its name only while it grows; the files stay.
    """

    def __init__(self, spark: SparkSession, by: list[str], buckets: int):
        self.spark, self.by, self.buckets = spark, by, buckets
        self.path = shared_folder(spark)
        self.name = f"weftline_{self.path.rsplit('-', 1)[-1]}"

    def append(self, df: DataFrame, at_once: bool = False) -> None:
        """df should come by repartition(buckets, *by): one file a bucket then.

        at_once: the plan is fixed before it runs, as one job, and joins by more
        columns than the buckets' leave both sides where they lie.
        """
        # a task holds one bucket, so it needn't be sorted by buckets
        own = {"spark.sql.maxConcurrentOutputFileWriters": "2"}
        if at_once:
            own |= {"spark.sql.adaptive.enabled": "false", "spark.sql.requireAllClusterKeysForCoPartition": "false"}
        before = {k: self.spark.conf.get(k) for k in own}
        try:
            for k, v in own.items():
                self.spark.conf.set(k, v)
            df.write.mode("append").bucketBy(self.buckets, *self.by).option("path", self.path).saveAsTable(self.name, format="parquet")
        finally:
            for k, v in before.items():
                self.spark.conf.set(k, v)

    def read(self) -> DataFrame:
        return self.spark.table(self.name)

    def closed(self) -> DataFrame:
        out = self.read()
        self.spark.sql(f"DROP TABLE {self.name}")
        return out
