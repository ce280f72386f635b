"""Every query against its SQL, and what the plans must look like."""

from __future__ import annotations

import math

import duckdb
import pytest
from conftest import SF_DIR

from __spark_entry__ import entry, oracle_sql, queries

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_DIR}/{t}.parquet')")
    return con


def normal(columns, rows):
    def plain(v):
        return ("nan" if math.isnan(v) else round(v, 6)) if isinstance(v, float) else v

    order = sorted(range(len(columns)), key=lambda i: columns[i])
    made = [tuple(plain(r[i]) for i in order) for r in rows]
    return sorted(columns), sorted(made, key=lambda r: tuple(map(str, r)))


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, sql, name):
    df = queries()[name](spark, SF_DIR)
    assert "CartesianProduct" not in plan_of(df)
    assert "BroadcastNestedLoopJoin" not in plan_of(df)
    got = normal(df.columns, [tuple(r) for r in df.collect()])
    assert got[1]
    if name in oracle_sql():
        found = sql.execute(oracle_sql()[name])
        assert got == normal([d[0] for d in found.description], found.fetchall())


def test_every_oracle_has_a_query():
    assert set(oracle_sql()) <= set(queries())


def test_entry(spark):
    assert entry(spark).columns == ["doc_id", "text", "note", "lang"]


def test_scans_read_only_the_columns_they_need(spark):
    plan = plan_of(queries()["chunk_table"](spark, SF_DIR))
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan
    plan = plan_of(queries()["resume_remaining"](spark, SF_DIR))
    assert "ReadSchema: struct<doc_id:bigint>" in plan


def test_positions_are_pushed_to_the_scan_of_a_saved_table(spark, folder):
    from glossa.operators.rows import assign_row_id, first_n
    from glossa.sources.tables import ingest_table

    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    saved = spark.read.parquet(ingest_table(docs, folder, "d"))
    assert "LessThan(row_id,10)" in plan_of(first_n(saved, 10))
    numbered = plan_of(assign_row_id(docs))
    assert "BroadcastHashJoin" in numbered and "SortMergeJoin" not in numbered


def test_counting_columns_needs_one_scan(spark):
    assert plan_of(queries()["column_stats"](spark, SF_DIR)).count("FileScan") == 1
