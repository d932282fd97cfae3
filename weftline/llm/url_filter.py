"""URL filters as a temporal list join (DataFrame functions only).

List entries are dated changes of a key: a host, a parent domain of it, or a
host with the first part of a path. Each entry holds from its date until the
key's next entry, so a list becomes validity intervals, and every capture is
judged by the entries that were active when it was fetched. The most specific
active key decides; a `block` there rejects the capture, an `allow` keeps it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import scratch, stored, table

#: Keys with more captures than HOT are dealt into shares of about so many each, and their entries repeated for each share.
HOT = 10_000


def host_of(url: Column) -> Column:
    """Lower-case host without user and port; null where the URL has none."""
    host = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1)
    return F.when(host != "", host)


def keys_of(url: Column) -> Column:
    """The keys that can hold for a URL, most specific first: host/part, host, parents of two labels or more."""
    host = host_of(url)
    part = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+/([^/?#]+)", 1)
    labels = F.split(host, r"\.")
    up = F.transform(F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1))), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    return F.when(part != "", F.concat(F.array(F.concat(host, F.lit("/"), part)), up)).otherwise(up)


def intervals(entries: DataFrame) -> DataFrame:
    """(key, action, since, until) of dated entries (key, listed_at, action).

    Of entries of one key and date, `block` holds. Entries without a key or
    date are void. The last entry has no end.
    """
    own = entries.where("key IS NOT NULL AND listed_at IS NOT NULL AND action IN ('block', 'allow')")
    own = own.groupBy("key", F.col("listed_at").alias("since")).agg(F.max("action").alias("action"))
    return own.withColumn("until", F.lead("since").over(Window.partitionBy("key").orderBy("since")))


def judge(captures: DataFrame, entries: DataFrame, hot_above: int = HOT) -> DataFrame:
    """(page_id, fetched_at, url, rule, since, blocked) of each capture (page_id, url, fetched_at).

    rule is the deciding key, null if none is active: such a capture isn't
    blocked, nor is one without a host or a fetch time. Captures that are equal
    in all three columns are returned once for each copy. A URL is read
    whole, however long. Null URLs and ones without a host have no key. Other
    columns of both tables are dropped; an empty list blocks nothing.
    """
    one = captures.groupBy("page_id", "url", "fetched_at").agg(F.count(F.lit(1)).alias("_copies"))
    asked = one.select("page_id", "url", "fetched_at", F.posexplode(keys_of(F.col("url"))).alias("_depth", "_ask"))
    # written first: of a table's size the planner knows whether to broadcast it, and then no shuffle deals captures by key alone
    hot = asked.groupBy(F.col("_ask").alias("_hot")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot_above).select("_hot", F.ceil(F.col("n") / hot_above).alias("_shares"))
    hot = stored(hot, f"{scratch(captures.sparkSession)}/hot")
    held = intervals(entries).select(F.col("key").alias("_key"), "action", "since", "until").join(hot, F.col("_key") == F.col("_hot"), "left")
    shares = F.when(F.col("_hot").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("_shares").cast("int") - 1))
    held = held.select("_key", "action", "since", "until", F.explode(shares).alias("_share"))
    share = F.when(F.col("_hot").isNull(), 0).otherwise(F.pmod(F.xxhash64("page_id", "url", "fetched_at"), F.col("_shares"))).cast("int")
    asked = asked.join(hot, F.col("_ask") == F.col("_hot"), "left").withColumn("_share", share).drop("_hot", "_shares")
    active = (F.col("_ask") == F.col("_key")) & (asked["_share"] == held["_share"]) & (F.col("fetched_at") >= F.col("since")) & (F.col("until").isNull() | (F.col("fetched_at") < F.col("until")))
    hits = asked.join(held, active)
    best = hits.groupBy("page_id", "url", "fetched_at").agg(F.min(F.struct("_depth", F.col("_ask").alias("rule"), "since", "action")).alias("_hit"))
    same = [F.col(f"c.{c}").eqNullSafe(F.col(f"b.{c}")) for c in ("page_id", "url", "fetched_at")]
    out = one.alias("c").join(best.alias("b"), same, "left")
    out = out.select("c.page_id", "c.url", "c.fetched_at", "_copies", "_hit.rule", "_hit.since", F.coalesce(F.col("_hit.action") == "block", F.lit(False)).alias("blocked"))
    return out.select("*", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int"))).alias("_copy")).drop("_copies", "_copy")


def _digit(key: Column, at: int) -> Column:
    """A number from 0 to 255 that the key decides."""
    return F.conv(F.substring(F.md5(key), at, 2), 16, 10).cast("int")


def captures_of(pages: DataFrame) -> DataFrame:
    """The test tables have no fetch times: page_id gives the day of 2024 (UTC days as numbers)."""
    return pages.select("page_id", "url", F.pmod(F.col("page_id") * 37, F.lit(365)).cast("int").alias("fetched_at"))


def sample_list(pages: DataFrame) -> DataFrame:
    """A dated list for the test tables: each key's digest says when it was blocked and allowed."""
    keys = pages.select(F.explode(keys_of(F.col("url"))).alias("key")).distinct()
    change = lambda at, action: F.struct(_digit(F.col("key"), at).alias("listed_at"), F.lit(action).alias("action"))
    dated = F.when(_digit(F.col("key"), 1) < 96, F.array(change(3, "block"), change(5, "allow"), change(7, "block")))
    return keys.select("key", F.explode(dated).alias("e")).select("key", "e.listed_at", "e.action")


def query(spark: SparkSession, pages: DataFrame) -> DataFrame:
    out = judge(captures_of(pages), sample_list(pages))
    return out.select("page_id", "url", "fetched_at", "rule", "since", "blocked")


def query_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return query(spark, table(spark, sf_dir, "pages").select("page_id", "url"))


SQL = r"""
WITH c AS (SELECT page_id, url, CAST((page_id * 37) % 365 AS INTEGER) AS fetched_at,
             nullif(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)', 1), '') AS host,
             regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+/([^/?#]+)', 1) AS part FROM pages),
l AS (SELECT *, string_split(host, '.') AS labels FROM c WHERE host IS NOT NULL),
k AS (SELECT page_id, url, fetched_at, 0 AS depth, host || '/' || part AS key FROM l WHERE part <> ''
      UNION ALL
      SELECT page_id, url, fetched_at, i, array_to_string(labels[i:], '.')
      FROM (SELECT *, unnest(range(1, greatest(len(labels) - 1, 1) + 1)) AS i FROM l)),
keys AS (SELECT DISTINCT key, md5(key) AS m FROM k),
e AS (SELECT key, CAST(('0x' || substr(m, 3, 2)) AS INTEGER) AS since, 'block' AS action FROM keys WHERE CAST(('0x' || substr(m, 1, 2)) AS INTEGER) < 96
      UNION ALL SELECT key, CAST(('0x' || substr(m, 5, 2)) AS INTEGER), 'allow' FROM keys WHERE CAST(('0x' || substr(m, 1, 2)) AS INTEGER) < 96
      UNION ALL SELECT key, CAST(('0x' || substr(m, 7, 2)) AS INTEGER), 'block' FROM keys WHERE CAST(('0x' || substr(m, 1, 2)) AS INTEGER) < 96),
v AS (SELECT *, lead(since) OVER (PARTITION BY key ORDER BY since) AS until
      FROM (SELECT key, since, max(action) AS action FROM e GROUP BY key, since)),
h AS (SELECT k.page_id, k.url, k.key AS rule, v.since, v.action,
        row_number() OVER (PARTITION BY k.page_id, k.url ORDER BY k.depth) AS r
      FROM k JOIN v ON k.key = v.key AND k.fetched_at >= v.since AND (v.until IS NULL OR k.fetched_at < v.until))
SELECT c.page_id, c.url, c.fetched_at, h.rule, h.since, coalesce(h.action = 'block', false) AS blocked
FROM c LEFT JOIN h ON c.page_id = h.page_id AND c.url = h.url AND h.r = 1
"""
