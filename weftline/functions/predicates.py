"""Predicates and classifications over run rows, as Column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Statuses that pass, and those that are hits.
PASSES = ("success", "cache-hit", "cache-hit-remote")
HITS = ("cache-hit", "cache-hit-remote")


def executed(status: str = "status") -> Column:
    return F.col(status) != "skipped"


def keyed(hash_: str = "hash") -> Column:
    return F.col(hash_) != ""


def passed(status: str = "status") -> Column:
    """False, never null, for an unknown or missing status."""
    return F.coalesce(F.col(status).isin(*PASSES), F.lit(False))


def hit(status: str = "status") -> Column:
    return F.coalesce(F.col(status).isin(*HITS), F.lit(False))


def cache_source(status: str = "status") -> Column:
    return F.when(F.col(status) == "cache-hit", "local").when(F.col(status) == "cache-hit-remote", "remote").when(F.col(status) == "skipped", "none").otherwise("miss")


def not_uncached() -> Column:
    """Null counts as cached: only a stored false excludes."""
    return ~F.col("cached").eqNullSafe(F.lit(False))


def observes_key() -> Column:
    return keyed() & not_uncached() & F.col("blocked_by").isNull()


def current_definition(current: str) -> Column:
    return F.col("def").isNull() | (F.col("def") == F.col(current))


def glob(column: str | Column, pattern: str) -> Column:
    """`*` matches anything, slashes too; every other character stands for itself."""
    body = ".*".join(re.escape(p) for p in pattern.split("*"))
    return (F.col(column) if isinstance(column, str) else column).rlike(f"(?s)^{body}$")


def path_glob(column: str, pattern: str) -> Column:
    """`**` is any number of directories, none included; `*` stays within one."""
    out = ""
    for part in re.split(r"(\*\*/|/\*\*$|\*\*|\*)", pattern):
        out += {"**/": "(?:[^/]+/)*", "/**": "(?:/.*)?", "**": ".*", "*": "[^/]*"}.get(part, re.escape(part))
    return F.col(column).rlike(f"^{out}$")


def at_or_under(column: str, directory: str) -> Column:
    return (F.col(column) == directory) | F.col(column).startswith(directory.rstrip("/") + "/")


def any_tag(column: str, pattern: str) -> Column:
    return F.coalesce(F.exists(column, lambda t: glob(t, pattern)), F.lit(False))


def measured(column: str) -> Column:
    """Finite and not negative."""
    c = F.col(column)
    return F.coalesce((c >= 0) & ~F.isnan(c) & (c != float("inf")), F.lit(False))


def policy_allows(column: str, store: str, mode: str) -> Column:
    """Whether a cache policy such as `local:rw,remote:r` has the mode for the store."""
    return F.col(column).rlike(rf"(?:^|,){store}:[rw]*{mode}")


#: Fixed value: names whose values are never shown.
SECRET_NAME = "(?i)(secret|token|password|key)"


def masked(kind: str, name: str, value: str) -> Column:
    return F.when((F.col(kind) == "env") & F.col(name).rlike(SECRET_NAME), "***").otherwise(F.col(value))
