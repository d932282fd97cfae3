"""Every registered query of the run-history engine against its SQL on another engine."""

from __future__ import annotations

import duckdb
import pytest

from weftline.plans import registry

TABLES = "events part orders lineitem documents".split()


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, bool) or v is None:
        return repr(v)
    if isinstance(v, (int, float)) or type(v).__name__ == "Decimal":
        return f"{float(v):.9g}"
    if isinstance(v, (list, tuple)):
        return str([plain(x) for x in v])
    return str(v)


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query(spark, sf, con, name):
    df = registry.QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    rel = con.sql(registry.SQL[name])
    assert sorted(rel.columns) == cols
    got = sorted(tuple(map(plain, r)) for r in df.select(*cols).collect())
    quoted = ", ".join(f'"{c}"' for c in cols)
    want = sorted(tuple(map(plain, r)) for r in con.sql(f"SELECT {quoted} FROM ({registry.SQL[name]})").fetchall())
    assert got == want


def test_entry_without_a_session_imports():
    import subprocess
    import sys

    subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; assert e.queries() and e.oracle_sql()"], check=True, cwd=str(__import__("pathlib").Path(__file__).parent.parent))
