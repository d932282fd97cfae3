"""Every query of the run-history engine by name, with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from ..sources.bindings import Tables, with_relations

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}
FLAGSHIP = "A1_task_stats"


def query(name: str, sql: str | None = None):
    """Registers f(tables) under a name, with SQL over the relations."""

    def register(f: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            SQL[name] = with_relations(sql)
        return f

    return register


from . import affected_queries, graph_queries, history_queries, key_queries, more_queries, plan_queries, rule_queries, stream_queries, time_queries  # noqa: E402, F401
