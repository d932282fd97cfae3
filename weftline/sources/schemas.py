"""Explicit schemas of the relations of a run history. Readers never infer."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(text: str) -> T.StructType:
    out = T.StructType()
    kinds = {"string": T.StringType(), "bigint": T.LongType(), "double": T.DoubleType(), "boolean": T.BooleanType()}
    for field in text.split(","):
        name, kind = field.split()
        out = out.add(name, kinds[kind], True)
    return out


RUNS = _struct(
    "id bigint, project string, task string, hash string, status string, duration_ms bigint, attempts bigint, cached boolean, cache_hit boolean, "
    "started_at bigint, ended_at bigint, run_id string, cpu_ms bigint, peak_rss bigint, cores bigint, blocked_by string, def string"
)
INVOCATIONS = _struct("run_id string, started_at bigint, ended_at bigint, task_count bigint, failed_count bigint, exit_ok boolean, cache_policy string")
ENTRIES = _struct("entry string, project string, task string, hash string, size_bytes bigint, accessed_at bigint, last_id bigint")
ENTRY_INPUTS = _struct("entry bigint, kind string, name string, hash string")
TASK_DURATIONS = _struct("id bigint, project string, task string, duration_ms bigint, source string, cores bigint")
EDGES = _struct("src bigint, dst bigint")
