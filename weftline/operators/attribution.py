"""What shared servers cost, charged to the tasks that used them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed value: the step of an update, as a share of the error.
RATE = 0.3


def _modelled(base: float, cost: dict, users: list) -> float:
    """Added one by one: sum() compensates its rounding, other engines don't."""
    for u in users:
        base += cost.get(u, 0.0)
    return base


def _learn(base: float, cost: dict, users: list, cores: float, capped: bool) -> float:
    """The new base; costs are updated in place. Users share the error, an idle look moves the base, neither falls below 0."""
    error = cores - _modelled(base, cost, users)
    if capped and error < 0:
        return base
    if not users:
        return max(0.0, base + RATE * error)
    step = RATE * error / len(users)
    for u in users:
        cost[u] = max(0.0, cost.get(u, 0.0) + step)
    return base


def charges(looks: DataFrame) -> DataFrame:
    """(server, id, base, task, cost, charged) of looks (server, id, users, cores, ms, capped), in the order of id.

    A server's cores are modelled as a base and one cost for each running
    user, learned look by look; a capped look may only raise them. Each user
    is charged its cost's part of cores * ms (core-ms). A look without users
    is one row without task. A null in cores or ms counts as 0, null users
    as none.

    The model depends on the order, so a server's looks pass one task; they
    are sorted and streamed, and only its model is held.
    """
    rows = looks.select("server", "id", F.coalesce("users", F.array().cast("array<string>")).alias("users"), F.coalesce(F.col("cores").cast("double"), F.lit(0.0)).alias("cores"),
                        F.coalesce(F.col("ms").cast("double"), F.lit(0.0)).alias("ms"), F.coalesce("capped", F.lit(False)).alias("capped"))
    kinds = {"base": T.DoubleType(), "task": T.StringType(), "cost": T.DoubleType(), "charged": T.DoubleType()}
    schema = T.StructType([*rows.select("server", "id").schema, *(T.StructField(n, k) for n, k in kinds.items())])

    def run(parts):
        import pyarrow as pa

        at, base, cost, started = None, 0.0, {}, False
        for part in parts:
            types = [part.schema.field("server").type, part.schema.field("id").type, pa.float64(), pa.string(), pa.float64(), pa.float64()]
            out = []
            for server, id_, users, cores, ms, capped in zip(*(part.column(c).to_pylist() for c in ("server", "id", "users", "cores", "ms", "capped")), strict=True):
                if not started or server != at:
                    at, base, cost, started = server, 0.0, {}, True
                base = _learn(base, cost, users, cores, capped)
                total = _modelled(base, cost, users)
                paid = cores > 0 and ms > 0 and total > 0
                for u in users:
                    c = cost.get(u, 0.0)
                    out.append((server, id_, base, u, c, cores * ms * c / total if paid else 0.0))
                if not users:
                    out.append((server, id_, base, None, None, None))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*out, strict=True), types, strict=True)], schema.names)

    return rows.repartition("server").sortWithinPartitions("server", "id").mapInArrow(run, schema)
