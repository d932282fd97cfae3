"""The stages of the pipeline, each on its predecessor's rows, and SQL against Spark."""

from __future__ import annotations

import duckdb
import pytest

import corpus_pipeline
from weftline.llm import queries

from .fixtures import SCHEMA, odd_rows
from .test_operators import brute_components, brute_lines, sha


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before = {r.doc_id: r for r in docs.collect()}
    stages = dict(corpus_pipeline.STAGES)

    told = stages["language ID"](spark, docs, sf).cache()
    assert told.columns == docs.columns
    assert {r.doc_id for r in told.collect()} == {i for i, r in before.items() if r.text and any(c.isalpha() for c in r.text)}

    lines = stages["line dedup"](spark, told, sf).cache()
    want = brute_lines([(r.doc_id, r.text) for r in told.collect()])
    assert {r.doc_id: sha(r.text) for r in lines.collect()} == {i: v[2] for i, v in want.items()}

    one = stages["near-dedup"](spark, lines, sf).cache()
    groups = brute_components([(r.doc_id, r.text) for r in lines.collect()], 5, 80)
    assert {r.doc_id for r in one.collect()} == {i for i, (_, c) in groups.items() if i == c}

    masked = stages["secret scan"](spark, one, sf).cache()
    assert masked.count() == one.count() and masked.columns == docs.columns
    packed = stages["packing"](spark, masked, sf)
    assert {r.doc_id for r in packed.collect()} == {r.doc_id for r in masked.collect()}


def test_language_stage_without_profiles(spark, sf):
    kept = [(1, "some words", None, "s", 10), (2, "中文", None, "s", 2)]
    docs = spark.createDataFrame([*kept, (3, "12 - 34", None, "s", 7), (4, None, None, "s", 0), (5, "", None, "s", 0)], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(map(tuple, corpus_pipeline.identify_language(spark, docs, sf).collect())) == kept


def test_run(spark, sf):
    assert corpus_pipeline.run(spark, sf).count() > 100


def test_run_over_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_run_over_odd_rows_and_clashing_columns(spark, tmp_path):
    odd = spark.createDataFrame(odd_rows(), SCHEMA).selectExpr("*", "'x' AS node", "1 AS n_lines", "2 AS score", "3 AS spans", "4 AS h")
    odd.write.parquet(f"{tmp_path}/documents.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    # the row without a text goes, and a repeated row is a copy of itself with one id: both stay
    assert sorted(r.doc_id or 0 for r in out) == [0, 500, 500, 501, 501] and all(r.piece == 0 and r.length > 1 for r in out)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = queries.QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    got = sorted((tuple(map(str, r)) for r in df.select(*cols).collect()))
    want = sorted(tuple(map(str, r)) for r in con.sql(f"SELECT {', '.join(cols)} FROM ({queries.SQL[name]})").fetchall())
    assert got == want and got
