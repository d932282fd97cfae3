"""Aggregate and scalar rules that differ from Spark's own functions of like name."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def nearest_rank(values: Column, q: float) -> Column:
    """sorted[floor(q * n)]: the upper middle of an even count; null of none. Nulls are left out.

    The list is kept to one group, so this is for groups of a few rows;
    stats.with_running_counts and counted_rank have the same rule for any size.
    """
    s = F.sort_array(F.collect_list(values))
    return F.get(s, F.floor(F.size(s) * F.lit(q)).cast("int"))


def counted_rank(value: Column, q: float) -> Column:
    """nearest_rank over rows of stats.with_running_counts."""
    return F.min(F.when(F.col("_upto") > F.floor(F.col("_of") * F.lit(q)), value))


def share(part: Column, whole: Column) -> Column:
    return F.try_divide(part.cast("double"), whole.cast("double"))


def least_or_null(a: Column, b: Column) -> Column:
    """The smaller, null if either is."""
    return F.when(a.isNotNull() & b.isNotNull(), F.least(a, b))


def clamp(x: Column, low: int, high: int) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def booked_cores(x: Column) -> Column:
    """To the nearest quarter, one at least."""
    return F.greatest(F.lit(1.0), F.round(x * 4) / 4)


def reserved_memory(peak: Column, step: int = 64 << 20) -> Column:
    """A quarter above the peak, up to whole steps; null where the peak is below one step."""
    return F.when(peak >= step, (F.ceil(peak * F.lit(1.25) / F.lit(step)) * step).cast("long"))


def alone_time(duration: Column, cpu: Column, busy: Column) -> Column:
    """How long a task would have taken alone, from its CPU time and its share of busy cores."""
    d, c, s = (x.cast("double") for x in (duration, cpu, busy))
    return F.when((s > 0) & (s < 1) & (d > 0), d - (c / s - c) / F.greatest(F.lit(1.0), c / (d * s))).otherwise(d)


def failure_mode(retried: Column, failures: Column, mixed: Column, total: Column) -> Column:
    """Flaky takes a sign of chance: a retried pass, or a key that failed after it had passed. Failures alone are breaks."""
    flaky = (retried > 0) | ((failures > 0) & (mixed > 0))
    return F.when(~flaky, "stable").when(failures.cast("double") < total.cast("double") / 5, "flaky-recoverable").otherwise("flaky-fatal")


def need() -> Column:
    """Cores that a run needs: CPU over its time, of which it had a share, at most what it was given."""
    ratio = F.try_divide(F.col("cpu_ms").cast("double"), F.col("duration_ms") * F.coalesce("cpu_share", F.lit(1.0)))
    return least_or_null(ratio, F.coalesce(F.col("cores").cast("double"), ratio))


#: Letters of size and duration literals.
SIZES = {"K": 1 << 10, "M": 1 << 20, "G": 1 << 30, "T": 1 << 40}
DURATIONS = {"ms": 1, "s": 1000, "m": 60_000, "h": 3_600_000, "d": 86_400_000}


def _literal(text: Column, units: dict[str, int], bare: bool) -> Column:
    pattern = f"^([0-9]+)({'|'.join(units)}){'?' if bare else ''}$"
    n, unit = F.regexp_extract(text, pattern, 1), F.regexp_extract(text, pattern, 2)
    factor = F.lit(1) if bare else F.lit(None)
    for name, value in units.items():
        factor = F.when(unit == name, F.lit(value)).otherwise(factor)
    return F.when(n != "", n.cast("long") * factor)


def parse_size(text: Column) -> Column:
    """Bytes of `512`, `64K`, `2G`; null for anything else, fractions too."""
    return _literal(text, SIZES, True)


def parse_duration(text: Column) -> Column:
    """Milliseconds of `500ms`, `30s`, `5m`, `2h`, `1d`; null for anything else, capitals too."""
    return _literal(text, DURATIONS, False)


def format_bytes(n: Column) -> Column:
    out = F.concat(n.cast("string"), F.lit(" B"))
    for unit, size in (("KiB", 1 << 10), ("MiB", 1 << 20), ("GiB", 1 << 30)):
        out = F.when(n >= size, F.concat(F.format_string("%.1f", n / F.lit(size)), F.lit(f" {unit}"))).otherwise(out)
    return out
