"""Whitening of embeddings by a covariance in two passes.

Exact integer sums give the mean; a second pass sums outer products of the
centred vectors by matrix products, one partial matrix for each partition,
merged as a tree. The eigenvectors of the one small matrix go back to the
tasks, which project every row.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch, stored

COMPONENTS = 16
SCALE, SHIFT = 64, 1_000_000
#: What floor(SCALE * c) is held to, so that it fits in a long with SHIFT added.
_LEAST, _MOST = -(2.0**63), 2.0**63 - 977 * 1024
_LONGEST = (1 << 63) - 1


@dataclass
class Fit:
    """What was learned from the distinct vectors of one length."""

    n: int
    sums: list[int]
    projection: np.ndarray  # dimensions x components, each eigenvector over the root of its eigenvalue; nan without variance
    explained: np.ndarray
    identity_error: float = 0.0

    @property
    def base(self) -> np.ndarray:
        """The mean rounded down; rest() is what it lacks, in n-ths."""
        return np.array([s // self.n for s in self.sums], np.int64)

    @property
    def rest(self) -> np.ndarray:
        return np.array([s % self.n for s in self.sums], np.int64)


def usable(vector: str = "embedding") -> Column:
    """Whether a vector is there and all its entries are finite."""
    fine = F.forall(F.col(vector), lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), F.lit(False)))
    return F.coalesce(fine, F.lit(False))


def whole_numbers(vector: str = "embedding") -> Column:
    """floor(64 * c) + 1,000,000 of each entry; what doesn't fit in a long counts as its end."""
    held = lambda c: F.greatest(F.least(c.cast("double") * SCALE, F.lit(_MOST)), F.lit(_LEAST))
    return F.transform(F.col(vector), lambda c: F.floor(held(c)) + F.lit(SHIFT).cast("long"))


def _matrices(column) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The rows of a list column by length: their places, and them as one matrix. Empty lists have none."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.diff(column.offsets.to_numpy())
    flat, starts = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()[:-1]
    for d in np.unique(sizes[sizes > 0]):
        rows = np.flatnonzero(sizes == d)
        yield rows, flat[starts[rows][:, None] + np.arange(d)]


def _centred(x: np.ndarray, fit: Fit) -> np.ndarray:
    if abs(int(x.min())) < 1 << 61 and abs(int(x.max())) < 1 << 61:
        return (x - fit.base).astype(np.float64) - fit.rest / fit.n
    return (x.astype(object) - fit.base.astype(object)).astype(np.float64) - fit.rest / fit.n


def _merged(a: dict, b: dict) -> dict:
    for d, parts in b.items():
        a[d] = [x + y for x, y in zip(a[d], parts, strict=True)] if d in a else parts
    return a


def _summed(xs: DataFrame, of: Callable[[np.ndarray], list]) -> dict[int, list]:
    """Per length of vectors the sums of of(matrix), added up in each partition and then as a tree."""

    def run(parts):
        total: dict = {}
        for part in parts:
            for _, x in _matrices(part.column("x")):
                _merged(total, {x.shape[1]: of(x)})
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(total)])], ["state"])

    return xs.select("x").mapInArrow(run, "state binary").rdd.map(lambda r: pickle.loads(r["state"])).treeAggregate({}, _merged, _merged)


def _counts(x: np.ndarray) -> list:
    # the halves of a number apart: neither sum can leave 64 bits within a batch
    high, low = (x >> 32).sum(0), (x & 0xFFFFFFFF).sum(0)
    return [len(x), np.array([(int(h) << 32) + int(l) for h, l in zip(high, low, strict=True)], object)]


def distinct_vectors(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    return vectors.where(usable(vector)).select(whole_numbers(vector).alias("x")).distinct()


def fit(vectors: DataFrame, components: int = COMPONENTS, vector: str = "embedding") -> dict[int, Fit]:
    """Learns from each distinct vector once; one Fit for each length that vectors have.

    What reaches the driver is a square matrix of the dimensions, whatever
    the number of rows. A component whose eigenvalue is 0 but for rounding
    has no variance: nan in its projection.
    """
    spark = vectors.sparkSession
    xs = stored(distinct_vectors(vectors, vector), f"{scratch(spark)}/distinct")
    fits = {d: Fit(n, [int(s) for s in sums], np.empty((d, 0)), np.empty(0)) for d, (n, sums) in _summed(xs, _counts).items()}
    held = spark.sparkContext.broadcast(fits)

    def outer(x: np.ndarray) -> list:
        z = _centred(x, held.value[x.shape[1]])
        return [z.T @ z]

    for d, (square,) in _summed(xs, outer).items():
        values, vectors_ = np.linalg.eigh(square / fits[d].n)
        order = np.argsort(-values, kind="stable")[:components]
        e, u, trace = values[order], vectors_[:, order], float(np.trace(square) / fits[d].n)
        # either sign is right; the largest entry is positive, so that reruns agree
        u = u * np.where(np.take_along_axis(u, np.abs(u).argmax(0)[None], 0) < 0, -1.0, 1.0)
        some = e > d * np.finfo(float).eps * max(float(values.max()), 0.0)
        fits[d].projection = np.where(some, u / np.sqrt(np.where(some, e, 1.0)), np.nan)
        fits[d].explained = np.where(some, e / trace if trace else 0.0, 0.0)
    held.unpersist()
    held = spark.sparkContext.broadcast(fits)

    def products(x: np.ndarray) -> list:
        f = held.value[x.shape[1]]
        w = _centred(x, f) @ f.projection[:, ~np.isnan(f.projection[0])]
        return [w.sum(0), w.T @ w]

    for d, (sums, square) in _summed(xs, products).items():
        mean = sums / fits[d].n
        fits[d].identity_error = float(np.abs(square / fits[d].n - np.outer(mean, mean) - np.eye(len(mean))).max(initial=0.0))
    held.unpersist()
    return fits


def _deviations(x: np.ndarray, f: Fit) -> list[int]:
    """Exact sums of (n * x - S)**2 over the dimensions; what doesn't fit in a long is its end."""
    far = max(abs(int(x.min())), abs(int(x.max()))) + int(np.abs(f.base).max()) + 1
    if far < 1 << 62 and (f.n * far) ** 2 * x.shape[1] <= _LONGEST:
        return ((f.n * (x - f.base) - f.rest) ** 2).sum(1).tolist()
    y, rest = x - f.base if far < 1 << 62 else x.astype(object) - f.base.astype(object), f.rest
    span = int(np.abs(y).max())
    if far < 1 << 62 and span * max(span, f.n) * x.shape[1] <= _LONGEST:
        # (n * y - r)**2 summed as three exact sums
        squares, mixed, rests = (y * y).sum(1).tolist(), (y @ rest).tolist(), sum(int(r) ** 2 for r in rest)
        return [min(f.n * f.n * a - 2 * f.n * b + rests, _LONGEST) for a, b in zip(squares, mixed, strict=True)]
    return [min(sum((f.n * int(v) - int(r)) ** 2 for v, r in zip(row, rest, strict=True)), _LONGEST) for row in y]


_MADE = "n bigint, deviation bigint, whitened array<double>, explained array<double>, identity_error double"


def whiten(rows: DataFrame, fits: dict[int, Fit], vector: str = "embedding") -> DataFrame:
    """rows whose vector takes part, with n, deviation, whitened, explained and identity_error.

    whitened and explained are arrays by component. Null in whitened: the
    component has no variance (one distinct vector, or fewer than
    dimensions). Rows with a null vector, null or non-finite entries, no
    entries, or of a length that the fit hasn't seen go. Ids may be null or
    repeated; columns of the made names give way to them. An empty table
    gives no row.
    """
    names = [m.split()[0] for m in _MADE.split(", ")]
    held = rows.sparkSession.sparkContext.broadcast(fits)
    kept = rows.where(usable(vector)).drop(*[c for c in names if c != vector])
    out, own = kept.columns, "_x"
    while own in out:
        own += "x"

    def run(parts):
        for part in parts:
            for places, x in _matrices(part.column(own)):
                f = held.value.get(x.shape[1])
                if f is None:
                    continue
                w = _centred(x, f) @ f.projection
                k, m = w.shape[1], len(x)
                offsets = pa.array(np.arange(m + 1, dtype=np.int32) * k)
                made = [
                    pa.array(np.full(m, f.n)), pa.array(_deviations(x, f), pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(w.ravel(), from_pandas=True)),
                    pa.ListArray.from_arrays(offsets, pa.array(np.tile(f.explained, m))), pa.array(np.full(m, f.identity_error)),
                ]
                some = part.take(pa.array(places))
                yield pa.RecordBatch.from_arrays([*[some.column(c) for c in out], *made], [*out, *names])

    schema = kept.schema
    for field in rows.sparkSession.createDataFrame([], _MADE).schema.fields:
        schema = schema.add(field)
    return kept.withColumn(own, whole_numbers(vector)).mapInArrow(run, schema)


def query(spark: SparkSession, vectors: DataFrame) -> DataFrame:
    out = whiten(vectors.select("vec_id", "embedding"), fit(vectors))
    each = F.posexplode(F.arrays_zip("whitened", "explained")).alias("at", "c")
    out = out.select("vec_id", "n", "deviation", "identity_error", each)
    return out.select("vec_id", (F.col("at") + 1).alias("component"), "n", "deviation", "c.whitened", "c.explained", "identity_error")
