"""Exact top-k by inner product through a paged M-tree.

The largest inner product is the smallest distance once every row has one
more component that brings all rows to the norm of the longest, and queries
have 0 there. In that metric the tree is loaded from the top: a node with more
rows than a page takes is divided among routing objects, middles of a bounded
sample of it, and each row goes below the nearest. Every node has its routing
object, its covering radius and its distance to the parent's routing object;
every row has its distance to its page's. Nodes and pages are tables, so
nothing that grows with the rows is in the driver or broadcast.

A query goes down to its most promising pages, which gives it a k-th best
distance. With that it starts again at the root and leaves out each node that
the k-th distance rules out: by the parent distance alone where that suffices,
else by the distance to the routing object less the radius. The pages that
are left are visited in the order of their bounds, the nearest first, in rounds
with the k-th distance and score carried on: a visit hands on only what is at or
above that score. Inside a page the stored parent distances say
which rows a query needs at all.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import scratch, stored

#: Rows that a page holds (equal rows and the last level apart, which are cut by hash), routing objects that divide a
#: node, rows of it that they are chosen from, about, and levels that there may be.
PAGE_ROWS, FAN, SAMPLED, LEVELS = 512, 32, 1024, 12
#: Queries that meet a node at a time, and rows of a node that are divided at a time.
QUERY_BLOCK, ROW_BLOCK = 1024, 100_000
#: Nodes that a query follows at each level on its way to the first pages, and pages that it visits in the round after.
BEAM, NEXT = 2, 8
#: Distances are off by no more than this part of the common norm.
SLACK = 1e-6
MOST = (1 << 63) - 1
NODE = "parent bigint, node bigint, centre array<double>, up double"
HITS = "query bigint, row bigint, vec_id bigint, score bigint, scored bigint"


def quantized(column: str) -> Column:
    """floor(1024 * x) of each component, at most what a long holds; null if the vector or a component is null or not finite."""
    big = F.transform(F.col(column), lambda x: F.when((x < 2.0**53) & (x >= -(2.0**53)), F.floor(F.lit(1024.0) * x.cast("double"))).otherwise(F.when(x > 0, F.lit(MOST)).otherwise(F.lit(-MOST))))
    bad = F.exists(F.col(column), lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(F.col(column).isNotNull() & ~F.coalesce(bad, F.lit(False)), big)


def _matrix(vectors, dim: int) -> np.ndarray:
    """Rows as float64, shorter vectors padded with zeros."""
    out = np.zeros((len(vectors), dim))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def _integers(vectors, dim: int) -> np.ndarray:
    out = np.zeros((len(vectors), dim), np.int64)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products of the rows of a with those of b. Sums beyond a long count as its end."""
    # as floats: the least long has no absolute value among longs
    most = np.abs(a.astype(float)).max(initial=0) * np.abs(b.astype(float)).max(initial=0) * a.shape[1]
    if most < 2**53:
        return np.rint(a.astype(float) @ b.astype(float).T).astype(np.int64)
    if most < 2**62:
        return a @ b.T
    exact = a.astype(object) @ b.astype(object).T
    return np.array([[min(max(x, -MOST), MOST) for x in row] for row in exact], np.int64).reshape(len(a), len(b))


def _lifted(rows: np.ndarray, longest: float) -> np.ndarray:
    return np.hstack([rows, np.sqrt(np.maximum(0, longest - (rows**2).sum(1)))[:, None]])


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, (a**2).sum(1)[:, None] + (b**2).sum(1)[None] - 2 * a @ b.T))


def _routing(sample: np.ndarray, fan: int) -> np.ndarray:
    """Routing objects: rows of the sample, which comes in a hashed order, moved to the middles of what is nearest to them.

    They stay in the middle and don't go on to the row next to it: in many
    dimensions one central row is the nearest of all to most middles, and
    would take everything below it.
    """
    first = np.sort(np.unique(sample, axis=0, return_index=True)[1])
    out = sample[first[:fan]]
    if len(first) > fan:
        for _ in range(6):
            own = _distances(sample, out).argmin(1)
            out = np.array([sample[own == i].mean(0) if (own == i).any() else out[i] for i in range(len(out))])
    return np.unique(out, axis=0)


class MTree:
    """The index over rows (row, vec_id, v), row being unique: levels of nodes, and pages of rows below the last."""

    def __init__(self, rows: DataFrame):
        spark = rows.sparkSession
        square = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
        shape = rows.agg(F.max(F.size("v")).alias("dim"), F.max(square).alias("longest"), F.count(F.lit(1)).alias("n")).first()
        self.empty = not shape["n"]
        if self.empty:
            return
        self.root, self.dim, self.longest = scratch(spark), shape["dim"], float(shape["longest"])
        self.slack = SLACK * np.sqrt(self.longest) + 1e-9
        #: One table for each level; a node that isn't divided has itself as the only child.
        self.levels: list[DataFrame] = []
        at = rows.withColumns({"node": F.lit(0).cast("long"), "up": F.lit(0.0)})
        nodes = spark.createDataFrame([(0, shape["n"], None)], "node long, n long, radius double")
        while True:
            level = len(self.levels)
            full = nodes.where((F.col("n") > PAGE_ROWS) & ((F.col("radius") > 0) | F.col("radius").isNull()))
            if level and (level == LEVELS or full.isEmpty()):
                break
            at, nodes = self._divide(at, nodes, full if level else nodes, level)
        # equal rows, and what the last level leaves, in pages of one routing object
        many = nodes.select("node", F.ceil(F.col("n") / PAGE_ROWS).alias("cuts"))
        page = F.pmod(F.xxhash64("row"), F.col("cuts")).cast("int")
        self.pages = stored(at.join(many, "node").withColumn("page", page).drop("cuts"), f"{self.root}/pages")
        self.cuts = many

    def _divide(self, at: DataFrame, nodes: DataFrame, full: DataFrame, level: int) -> tuple[DataFrame, DataFrame]:
        """Rows and nodes one level down: rows of full nodes go below routing objects of their own, the others stay."""
        dim, longest, root = self.dim, self.longest, f"{self.root}/{level}"
        # as many routing objects as leave about half a page to each, FAN at most
        fan = F.least(F.lit(FAN), F.greatest(F.lit(2), F.ceil(2 * F.col("n") / PAGE_ROWS))).cast("int")
        share = full.select("node", (F.lit(float(SAMPLED)) / F.col("n")).alias("share"), F.ceil(F.col("n") / ROW_BLOCK).alias("blocks"), fan.alias("fan"))
        share = stored(share, f"{root}-full")
        draw = F.pmod(F.xxhash64("row", F.lit(level)), F.lit(1_000_003)) / F.lit(1_000_003.0)
        above = self.levels[-1].select(F.col("node").alias("of"), "centre") if self.levels else None
        sample = at.join(share, "node").where(draw <= F.col("share")).select("node", "v", "fan", F.xxhash64("row", F.lit(level), F.lit("order")).alias("order"))

        def choose(own: pd.DataFrame) -> pd.DataFrame:
            own = own.sort_values("order", kind="stable")
            node, centres = int(own["node"].iloc[0]), _routing(_lifted(_matrix(own["v"], dim), longest), int(own["fan"].iloc[0]))
            return pd.DataFrame({"parent": node, "node": node * FAN + np.arange(1, len(centres) + 1), "centre": list(centres)})

        routers = sample.groupBy("node").applyInPandas(choose, "parent bigint, node bigint, centre array<double>")
        routers = stored(routers, f"{root}-routers")

        def place(rows: pd.DataFrame, routing: pd.DataFrame) -> pd.DataFrame:
            if len(rows):
                d = _distances(_lifted(_matrix(rows["v"], dim), longest), np.array(routing["centre"].tolist()))
                near = d.argmin(1)
                rows = rows.assign(node=routing["node"].to_numpy()[near], up=d[np.arange(len(d)), near])
            return rows[["row", "vec_id", "v", "node", "up"]]

        block = F.pmod(F.xxhash64("row"), F.col("blocks"))
        asked = at.join(share.drop("share", "fan"), "node").withColumn("block", block).drop("blocks").groupBy("node", "block")
        repeated = routers.join(share.select(F.col("node").alias("parent"), "blocks"), "parent").select("parent", "node", "centre", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block")).groupBy("parent", "block")
        moved = asked.cogroup(repeated).applyInPandas(place, "row bigint, vec_id bigint, v array<bigint>, node bigint, up double")
        stay = at.join(share.select("node"), "node", "left_anti").select("row", "vec_id", "v", "node", "up")
        at = stored(moved.unionByName(stay), f"{root}-rows")

        held = at.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.max("up").alias("radius"))
        made = routers
        if above is not None:
            step = F.sqrt(F.aggregate(F.zip_with("centre", F.col("above"), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x))
            made = routers.join(above.select(F.col("of").alias("parent"), F.col("centre").alias("above")), "parent").withColumn("up", step).drop("above")
            same = self.levels[-1].join(share.select("node"), "node", "left_anti").select(F.col("node").alias("parent"), "node", "centre", F.lit(0.0).alias("up"))
            made = made.select("parent", "node", "centre", "up").unionByName(same)
        else:
            made = made.withColumn("up", F.lit(0.0))
        self.levels.append(stored(made.join(held, "node"), f"{root}-nodes"))
        return at, self.levels[-1].select("node", "n", "radius")

    def _descend(self, queries: DataFrame, blocks: int, beam: int) -> DataFrame:
        """(query, v, reach, node, page, least, away) for the pages that a query may need: the nearest `beam` nodes at
        each level if set, else all that reach doesn't rule out. least: no row of the page is nearer."""
        dim, slack = self.dim, self.slack
        schema = "query bigint, v array<bigint>, reach double, node bigint, away double, least double"
        here = queries.select("query", "v", "reach", F.lit(0).cast("long").alias("node"), F.lit(0.0).alias("away"))
        for level in self.levels:

            def step(asked: pd.DataFrame, children: pd.DataFrame) -> pd.DataFrame:
                none = pd.DataFrame({"query": np.empty(0, np.int64), "v": np.empty(0, object), "reach": np.empty(0), "node": np.empty(0, np.int64), "away": np.empty(0), "least": np.empty(0)})
                if not len(asked) or not len(children):
                    return none
                radius, up, reach = children["radius"].to_numpy(), children["up"].to_numpy(), asked["reach"].to_numpy()[:, None]
                # what the parent distance alone rules out needs no distance
                open_ = np.abs(asked["away"].to_numpy()[:, None] - up) - radius <= reach + slack
                open_ |= int(asked["node"].iloc[0]) == 0  # the root has no routing object
                need = open_.any(0)
                q = np.hstack([_matrix(asked["v"], dim), np.zeros((len(asked), 1))])
                d = np.full(open_.shape, np.inf)
                d[:, need] = _distances(q, np.array(children["centre"].tolist())[need])
                least = np.maximum(0, d - radius)
                i, j = np.nonzero(open_ & (least <= reach + slack))
                return pd.DataFrame({"query": asked["query"].to_numpy()[i], "v": asked["v"].to_numpy()[i], "reach": reach[i, 0], "node": children["node"].to_numpy()[j], "away": d[i, j], "least": least[i, j]})

            block = F.pmod(F.xxhash64("query"), F.lit(blocks)).cast("int")
            asked = here.withColumn("block", block).groupBy("node", "block")
            children = level.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).groupBy("parent", "block")
            here = asked.cogroup(children).applyInPandas(step, schema)
            if beam:
                near = F.row_number().over(Window.partitionBy("query").orderBy("least", "away", "node"))
                here = here.withColumn("turn", near).where(F.col("turn") <= beam).drop("turn")
        out = here.join(self.cuts, "node")
        return out.withColumn("page", F.explode(F.sequence(F.lit(0), F.col("cuts").cast("int") - 1))).drop("cuts")

    def _visited(self, visits: DataFrame, k: int, blocks: int, counted: bool) -> DataFrame:
        """The rows of each visited page that can be among the k best of its queries: those at or above the k-th score so far.

        Counted, a visit has one row more, without a row number: `scored` is what it took.
        """
        dim, slack = self.dim, self.slack
        visits = visits.withColumn("block", F.pmod(F.xxhash64("query"), F.lit(blocks)).cast("int"))
        place = ["node", "page"]
        # a page is repeated only for the blocks with a query that goes there
        pages = self.pages.join(visits.select(*place, F.col("block").alias("for")).distinct(), place).withColumnRenamed("for", "block")

        def best(page: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
            none = pd.DataFrame({c.split()[0]: np.empty(0, np.int64) for c in HITS.split(", ")})
            if not len(page) or not len(asked):
                return none
            page = page.sort_values("up", kind="stable")
            up, away, reach = page["up"].to_numpy(), asked["away"].to_numpy(), asked["reach"].to_numpy()
            # the triangle inequality on parent distances leaves each query one stretch of the page, or nothing
            low, high = np.searchsorted(up, away - reach - slack, "left"), np.searchsorted(up, away + reach + slack, "right")
            asked, low, high = asked[low < high], low[low < high], high[low < high]
            if not len(asked):
                return none
            first, last = low.min(), high.max()
            names, ids, query = page["row"].to_numpy()[first:last], page["vec_id"].to_numpy()[first:last], asked["query"].to_numpy()
            s = _products(_integers(asked["v"], dim), _integers(page["v"].iloc[first:last], dim))
            at = np.arange(first, last)
            # equals of the k-th may still take its place, by their vec_id
            fits = (at >= low[:, None]) & (at < high[:, None]) & (s >= asked["kth"].to_numpy()[:, None]) & (names != query[:, None])
            for i in np.flatnonzero(fits.sum(1) > k):
                own = np.flatnonzero(fits[i])
                order = np.lexsort((names[own], ids[own], -s[i, own]))[k:]
                fits[i, own[order]] = False
            i, j = np.nonzero(fits)
            out = pd.DataFrame({"query": query[i], "row": names[j], "vec_id": ids[j], "score": s[i, j], "scored": 0})
            if counted:
                out = pd.concat([out, pd.DataFrame({"query": query, "row": -1, "vec_id": 0, "score": 0, "scored": high - low})])
            return out

        key = [*place, "block"]
        return pages.groupBy(*key).cogroup(visits.groupBy(*key)).applyInPandas(best, HITS)

    def search(self, queries: DataFrame, k: int, counted: bool = False) -> DataFrame:
        """query, rank, row, vec_id, score of the k best other rows; queries as (query, v).

        Counted, also scored: how many scores a query took.
        """
        spark = queries.sparkSession
        schema = "query bigint, rank int, row bigint, vec_id bigint, score bigint, scored bigint"
        if self.empty:
            return spark.createDataFrame([], schema)
        blocks = max(1, -(-queries.count() // QUERY_BLOCK))
        root, longest = scratch(spark), self.longest
        order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id", "row")

        def top(hits: DataFrame) -> DataFrame:
            # the rows that count come first or last of their query by their number; they have no rank
            took = hits.withColumn("took", F.sum("scored").over(Window.partitionBy("query"))).where("row >= 0") if counted else hits.withColumn("took", F.lit(0).cast("long"))
            return took.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).drop("scored").withColumnRenamed("took", "scored")

        def merged(found: DataFrame, more: DataFrame) -> DataFrame:
            # what a query took so far counts once
            once = F.when(F.col("rank") == 1, F.col("scored")).otherwise(0).cast("long")
            return top(found.withColumn("scored", once).drop("rank").unionByName(more))

        def reaching(found: DataFrame) -> DataFrame:
            """Queries with their k-th score so far and how far that row is: infinitely, where there is none yet."""
            kth = found.where(F.col("rank") == k).select("query", F.col("score").alias("kth"))
            norm = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
            far = F.sqrt(F.greatest(F.lit(0.0), norm + F.lit(longest) - 2 * F.col("kth").cast("double")))
            return queries.join(kth, "query", "left").select("query", "v", F.when(F.col("kth").isNull(), float("inf")).otherwise(far).alias("reach"), F.coalesce("kth", F.lit(-MOST)).alias("kth"))

        start = queries.withColumn("reach", F.lit(float("inf")))
        first = stored(self._descend(start, blocks, BEAM), f"{root}/first")
        found = stored(top(self._visited(first.withColumn("kth", F.lit(-MOST)), k, blocks, counted)), f"{root}/found-0")
        place = ["query", "node", "page"]
        open_ = self._descend(reaching(found).drop("kth"), blocks, 0).join(first.select(*place), place, "left_anti")
        turn = F.row_number().over(Window.partitionBy("query").orderBy("least", "node", "page"))
        open_ = stored(open_.withColumn("turn", turn).drop("reach"), f"{root}/open")
        done, upto = 0, NEXT
        while True:
            # each round eight times as many pages, with the k-th score of the round before
            left = open_.where(F.col("turn") > done).join(reaching(found).select("query", "reach", "kth"), "query").where(F.col("least") <= F.col("reach") + F.lit(self.slack))
            if left.isEmpty():
                return found.select("query", F.col("rank").cast("int").alias("rank"), "row", "vec_id", "score", "scored")
            now = left.where(F.col("turn") <= upto).drop("turn")
            found = stored(merged(found, self._visited(now, k, blocks, counted)), f"{root}/found-{upto}")
            done, upto = upto, upto * 8


def top_k(vectors: DataFrame, k: int = 10, every: int = 100) -> DataFrame:
    """query_id, rank, vec_id and score of the k rows of largest integer inner product for each row whose vec_id is
    divisible by `every`.

    Vectors that are null, or hold a null or non-finite component, take no
    part, nor do rows without vec_id. Every row but the query's own is a
    candidate: of rows with one vec_id each has its place, and each is a query
    of its own. Shorter vectors count as padded with zeros. Equal scores go to
    the smaller vec_id. Components that don't fit in a long after scaling, and
    scores that don't, count as the largest long or its negative. Other
    columns are dropped.
    """
    return _ranked(vectors, k, every, False).drop("scored")


def top_k_costs(vectors: DataFrame, k: int = 10, every: int = 100) -> DataFrame:
    """top_k() and scored, the number of scores that each query took."""
    return _ranked(vectors, k, every, True)


def _ranked(vectors: DataFrame, k: int, every: int, counted: bool) -> DataFrame:
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), quantized("embedding").alias("v")).where("vec_id IS NOT NULL AND v IS NOT NULL")
    # numbered once, in the written table
    rows = stored(rows.withColumn("row", F.monotonically_increasing_id()), f"{scratch(vectors.sparkSession)}/vectors")
    queries = rows.where(F.col("vec_id") % every == 0)
    hits = MTree(rows).search(queries.select(F.col("row").alias("query"), "v"), k, counted)
    names = queries.select(F.col("row").alias("query"), F.col("vec_id").alias("query_id"))
    return hits.join(names, "query").select("query_id", "rank", "vec_id", "score", "scored")


def query(spark: SparkSession, vectors: DataFrame) -> DataFrame:
    return top_k(vectors)


SQL = """
WITH ok AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CASE WHEN x < 9007199254740992 AND x >= -9007199254740992 THEN CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)
           WHEN x > 0 THEN 9223372036854775807 ELSE -9223372036854775807 END) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.r AS q, q.vec_id AS query_id, c.r AS c, c.vec_id,
        least(greatest(list_sum(list_transform(range(1, least(len(q.v), len(c.v)) + 1), lambda i: CAST(q.v[i] AS HUGEINT) * c.v[i])), -9223372036854775807), 9223372036854775807) AS score
      FROM ok q JOIN ok c ON q.r <> c.r WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, vec_id, c) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, CAST(score AS BIGINT) AS score FROM r WHERE rank <= 10
"""
