"""Secret scans with multipart credential linking (DataFrame functions only).

Three kinds are reported wherever they occur: assignments, access identifiers
and long hex strings. Two kinds are too weak alone. A bare mixed-case token is
reported only near an access identifier; an endpoint only near both an access
identifier and something secret. "Near" is a scope of so many code points
around a span, and the parts meet in an interval join on buckets of positions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import packed, row_key, scratch, stored, whole_text, with_made

#: Kinds in the order in which they are listed.
KINDS = ("assign", "access", "hex", "weak_secret", "endpoint")
SPANS = "array<struct<start:int,kind:int,end:int>>"


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_NAMES = "|".join(map(_either_case, ("password", "passwd", "secret", "token", "api_?key")))
ASSIGN = rf"""({_NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: A maximal run of one class that is too short holds no long enough one, so the least length can stand in the pattern.
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
WEAK = r"[A-Za-z0-9/+=]{32,}"
ENDPOINT = r"https?://[A-Za-z0-9.-]+(?::[0-9]+)?"
#: Code points between two spans that still share a scope.
REACH = 256
_BUCKET = 1024
#: Elements of a block of a running sum, and code points of a piece of a text that is cut.
_STEP, _PIECE = 256, 4096


def _let(value: str, name: str, body: str) -> str:
    """SQL of body with a value that is computed once: inside a lambda an expression would be computed for each element."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def running(values: str, combine: str = "{0} + {1}") -> str:
    """SQL: for each number of an array what combines all before it, from 0.

    An accumulator that grows is copied at each step, so the array is taken in
    blocks of 256, and then their totals: 128 copies an element, and for the
    totals one for every 131,072 pairs of elements.
    """
    zero = "named_struct('at', 0, 'before', cast(array() as array<int>))"
    one = lambda block: f"aggregate({block}, {zero}, (acc, y) -> named_struct('at', {combine.format('acc.at', 'y')}, 'before', concat(acc.before, array(acc.at))))"
    blocks = f"transform(sequence(0, cast(floor(greatest(size(v) - 1, 0) / {_STEP}) as int)), b -> {one(f'slice(v, b * {_STEP} + 1, {_STEP})')})"
    before = one("transform(ps, p -> p.at)") + ".before"
    joined = f"flatten(zip_with(ps, {before}, (p, o) -> transform(p.before, w -> {combine.format('o', 'w')})))"
    return _let(values, "v", _let(blocks, "ps", joined))


def _spans(text: str, pattern: str, kind: int, ok: str = "true") -> str:
    """SQL of the spans of the leftmost non-overlapping matches that are ok, in code points.

    Spark has no function for match positions; they are running sums of the
    lengths of the matches and of the text between them.
    """
    find = _quoted(pattern)
    sizes = f"zip_with(split({text}, {find}, -1), regexp_extract_all({text}, {find}, 0), (gap, hit) -> named_struct('gap', length(gap), 'hit', length(hit), 'good', hit is not null and {ok}))"
    before = running("transform(both, x -> x.gap + coalesce(x.hit, 0))")
    span = f"if(x.good, named_struct('start', s + x.gap, 'kind', {kind}, 'end', s + x.gap + x.hit), null)"
    placed = f"array_compact(zip_with(both, {before}, (x, s) -> {span}))"
    # most texts have no match: one part, whose length nobody needs
    return _let(sizes, "both", f"if(size(both) > 1, cast({placed} as {SPANS}), cast(array() as {SPANS}))")


_MIXED = "length(hit) <= 64 and hit rlike '[0-9]' and hit rlike '[A-Z]' and hit rlike '[a-z]'"


def base_spans(text: str) -> str:
    """SQL of the base spans of a text, by start, then kind."""
    assign = _spans(text, ASSIGN, 0, f"length(regexp_extract(hit, {_quoted(ASSIGN)}, 2)) >= 6")
    return f"array_sort(concat({assign}, {_spans(text, ACCESS, 1)}, {_spans(text, HEX, 2)}))"


def may_link(text: Column) -> Column:
    """Without an access identifier nothing weak is ever reported."""
    return F.contains(text, F.lit("AKIA"))


def scan(docs: DataFrame) -> DataFrame:
    """Key, base spans and weak candidates of each row of docs, without its text."""
    text = "coalesce(text, '')"
    weak = F.when(may_link(F.expr(text)), F.expr(f"concat({_spans(text, WEAK, 3, _MIXED)}, {_spans(text, ENDPOINT, 4)})"))
    return docs.select("doc_id", *row_key(), F.expr(base_spans(text)).alias("base"), F.coalesce(weak, F.array().cast(SPANS)).alias("weak"))


def _exploded(found: DataFrame, spans: Column) -> DataFrame:
    return found.select("_id", "_th", F.explode(spans).alias("s")).select("_id", "_th", "s.start", "s.kind", "s.end")


def within_reach(parts: DataFrame, others: DataFrame, reach: int = REACH, how: str = "left_semi") -> DataFrame:
    """The parts that have one of others in their scope (left_anti: that have none): an interval join.

    Both sides are dealt to the position buckets that they touch, so the join
    is on equal keys and only compares spans that are close. A reach of -1
    asks for an overlap.
    """
    cell = lambda lo, hi: F.explode(F.sequence(F.floor(lo / _BUCKET), F.floor(hi / _BUCKET)))
    a = parts.withColumn("cell", cell(F.col("start"), F.col("end")))
    b = others.select(F.col("_id").alias("_oid"), F.col("_th").alias("_oth"), (F.col("start") - reach).alias("lo"), (F.col("end") + reach).alias("hi")).where("lo <= hi")
    b = b.withColumn("ocell", cell(F.greatest("lo", F.lit(0)), F.col("hi")))
    on = (F.col("_id") == F.col("_oid")) & (F.col("_th") == F.col("_oth")) & (F.col("cell") == F.col("ocell")) & (F.col("start") <= F.col("hi")) & (F.col("end") >= F.col("lo"))
    met = a.join(b, on, "left_semi").drop("cell").distinct()
    return met if how == "left_semi" else parts.join(met, ["_id", "_th", "start", "kind", "end"], how)


def link(found: DataFrame, reach: int = REACH) -> DataFrame:
    """Weak spans of each key that complementary parts in their scope confirm."""
    is_kind = lambda *kinds: lambda s: s["kind"].isin(*kinds)
    some = found.where(F.size("weak") > 0)
    base = _exploded(some, F.col("base"))
    access = base.where("kind = 1")
    weak = within_reach(within_reach(_exploded(some, F.filter("weak", is_kind(3))), access, reach), base, -1, "left_anti")
    ends = within_reach(_exploded(some, F.filter("weak", is_kind(4))), access, reach)
    ends = within_reach(ends, base.where("kind <> 1").unionByName(weak), reach)
    span = F.struct("start", "kind", "end")
    return weak.unionByName(ends).groupBy(F.col("_id").alias("_lid"), F.col("_th").alias("_lth")).agg(F.collect_set(span).alias("linked"))


def find_secrets(docs: DataFrame, reach: int = REACH) -> DataFrame:
    """doc_id, key, base spans and all spans of each row of docs.

    Null text has no spans. Repeated rows and null ids are kept apart by id
    and text; rows equal in both get the same spans. Spans are ordered by
    start, then kind, and may overlap between kinds.
    """
    found = stored(scan(docs), f"{scratch(docs.sparkSession)}/spans")
    linked = link(found, reach)
    out = found.join(linked, (F.col("_id") == F.col("_lid")) & (F.col("_th") == F.col("_lth")), "left")
    every = F.array_sort(F.concat("base", F.coalesce("linked", F.array().cast(SPANS))))
    return out.select("doc_id", "_id", "_th", "base", every.alias("spans"))


def listed(spans: str) -> Column:
    kind = lambda k: F.element_at(F.array(*map(F.lit, KINDS)), k + 1)
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", kind(s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def masked(text: str, spans: str, mask: str) -> Column:
    """text with its spans (ordered by start) replaced; what overlaps becomes one mask.

    The text is cut into pieces once, so that no part of it is looked for from
    the start, and the result is joined once.
    """

    def between(start: str, end: str) -> str:
        """The text from start to end, end exclusive."""
        low = f"greatest({start} - i * {_PIECE}, 0)"
        share = f"substring(element_at(t.pieces, i + 1), {low} + 1, least({end} - i * {_PIECE}, {_PIECE}) - {low})"
        numbers = f"sequence(cast(floor({start} / {_PIECE}) as int), cast(floor(({end} - 1) / {_PIECE}) as int))"
        return f"if({end} > {start}, array_join(transform({numbers}, i -> {share}), ''), '')"

    # far: how far the spans before each span go
    parts = f"zip_with(t.spans, far, (s, at) -> if(s.start >= at, concat({between('at', 's.start')}, {_quoted(mask)}), ''))"
    tail = _let("array_max(transform(t.spans, s -> s.end))", "last", between("last", "t.n"))
    made = _let(running("transform(t.spans, s -> s.end)", "greatest({0}, {1})"), "far", f"concat(array_join({parts}, ''), {tail})")
    cut = f"named_struct('pieces', regexp_extract_all({text}, '(?s).{{1,{_PIECE}}}', 0), 'spans', spans, 'n', length({text}))"
    whole = _let(spans, "spans", f"if(size(spans) > 0, {_let(cut, 't', made)}, {text})")
    return F.expr(whole)


def mask_secrets(docs: DataFrame, mask: str = "[SECRET]", reach: int = REACH) -> DataFrame:
    """docs with every span of text replaced; overlapping spans become one mask. No row goes.

    Only texts in which weak parts may be linked are shuffled, to meet what
    the join found; all others are masked where they are.
    """
    linking = F.coalesce(may_link(F.col("text")), F.lit(False))
    alone = docs.where(~linking)
    plain = alone.select(packed(docs, "text"), masked("text", base_spans("coalesce(text, '')"), mask).alias("_text"))
    some = docs.where(linking)
    found = find_secrets(some.select("doc_id", "text"), reach).where(F.size("spans") > 0)
    found = found.select(F.col("_id").alias("_fid"), F.col("_th").alias("_fth"), "spans").dropDuplicates(["_fid", "_fth"])
    left = some.select(packed(docs, "text"), *row_key(), F.col("text").alias("_text"))
    met = left.join(found, (F.col("_id") == F.col("_fid")) & (F.col("_th") == F.col("_fth")), "left")
    met = met.select("_row", F.when(F.col("spans").isNull(), F.col("_text")).otherwise(masked("_text", "spans", mask)).alias("_text"))
    return with_made(plain.unionByName(met), docs, {"text": F.col("_text")})


def query(spark: SparkSession, docs: DataFrame) -> DataFrame:
    out = find_secrets(docs.select("doc_id", "text"))
    n = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return out.select("doc_id", n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"), F.sha2(listed("base"), 256).alias("base_sha256"), listed("spans").alias("spans"))


def _sql_spans(name: str, kind: int, pattern: str, ok: str) -> str:
    quoted = "'" + pattern.replace("'", "''") + "'"
    return f"""
{name} AS (
  SELECT doc_id, {kind} AS kind, s, s + length(hit) AS e FROM (
    SELECT doc_id, m[i] AS hit,
           list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0) AS s
    FROM (SELECT doc_id, m, p, unnest(range(1, len(m) + 1)) AS i FROM (
      SELECT doc_id, regexp_extract_all(text, {quoted}) AS m, string_split_regex(text, {quoted}) AS p FROM d)))
  WHERE {ok.replace("PATTERN", quoted)})"""


SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
{_sql_spans("a", 0, ASSIGN, "length(regexp_extract(hit, PATTERN, 2)) >= 6")},
{_sql_spans("k", 1, ACCESS, "true")},
{_sql_spans("h", 2, HEX, "true")},
{_sql_spans("w0", 3, WEAK, "length(hit) <= 64 AND regexp_matches(hit, '[0-9]') AND regexp_matches(hit, '[A-Z]') AND regexp_matches(hit, '[a-z]')")},
{_sql_spans("e0", 4, ENDPOINT, "true")},
base AS (SELECT * FROM a UNION ALL SELECT * FROM k UNION ALL SELECT * FROM h),
w AS (SELECT * FROM w0
      WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = w0.doc_id AND b.s < w0.e AND w0.s < b.e)
        AND EXISTS (SELECT 1 FROM k WHERE k.doc_id = w0.doc_id AND w0.s <= k.e + {REACH} AND w0.e >= k.s - {REACH})),
x AS (SELECT * FROM a UNION ALL SELECT * FROM h UNION ALL SELECT * FROM w),
en AS (SELECT * FROM e0
       WHERE EXISTS (SELECT 1 FROM k WHERE k.doc_id = e0.doc_id AND e0.s <= k.e + {REACH} AND e0.e >= k.s - {REACH})
         AND EXISTS (SELECT 1 FROM x WHERE x.doc_id = e0.doc_id AND e0.s <= x.e + {REACH} AND e0.e >= x.s - {REACH})),
every AS (SELECT * FROM base UNION ALL SELECT * FROM w UNION ALL SELECT * FROM en),
g AS (SELECT doc_id, count(*) FILTER (WHERE kind = 0) AS n0, count(*) FILTER (WHERE kind = 1) AS n1, count(*) FILTER (WHERE kind = 2) AS n2,
        string_agg(['assign','access','hex','weak_secret','endpoint'][kind + 1] || ':' || s || ':' || e, ',' ORDER BY s, kind) FILTER (WHERE kind < 3) AS b,
        string_agg(['assign','access','hex','weak_secret','endpoint'][kind + 1] || ':' || s || ':' || e, ',' ORDER BY s, kind) AS t
      FROM every GROUP BY doc_id)
SELECT d.doc_id, coalesce(n0, 0) AS n_assign, coalesce(n1, 0) AS n_access, coalesce(n2, 0) AS n_hex,
       sha256(coalesce(b, '')) AS base_sha256, coalesce(t, '') AS spans
FROM d LEFT JOIN g ON d.doc_id = g.doc_id
"""
