"""Sources, sinks, row positions."""

from __future__ import annotations

import os

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from glossa.operators import rows as rw
from glossa.session import FileSystem, WorkFolder
from glossa.sources import lake, publish, tables

ODD_CELLS = [
    '{"a": "x, \\"y\\""}',
    'line one\nline "two", three',
    "  padded  ",
    "",
    None,
    "NA",
    "back\\slash \\\" quote",
    "\t",
    "größe 😀",
]


def odd(spark):
    return spark.createDataFrame([(i, c) for i, c in enumerate(ODD_CELLS)], "row_id long, cell string")


def test_csv_round_trip(spark, folder):
    df = odd(spark)
    tables.write_table(df, folder, "org/odd")
    assert sorted(os.listdir(folder)) == ["org_odd.csv", "org_odd.parquet"]
    for kind in ("csv", "parquet"):
        back = tables.read_table(spark, tables.table_path(folder, "org/odd", kind), df.schema)
        # CSV cannot tell an empty cell from null.
        want = [c or None for c in ODD_CELLS] if kind == "csv" else ODD_CELLS
        assert [r.cell for r in back.orderBy("row_id").collect()] == want, kind


def test_csv_of_other_writers(spark, folder):
    path = f"{folder}/in.csv"
    with open(path, "w", encoding="utf-8-sig", newline="") as f:
        f.write('id,cell\n1,"[{""content"": ""a, b""}]"\n2," x "\n3,\n4,NA\n5,"a\nb"\n')
    got = tables.read_table(spark, path).collect()
    assert got[0].asDict() == {"id": "1", "cell": '[{"content": "a, b"}]'}
    assert [r.cell for r in got[1:]] == [" x ", None, "NA", "a\nb"]
    with open(f"{folder}/empty.csv", "w", encoding="utf-8") as f:
        f.write("id,cell\n")
    none = tables.read_table(spark, f"{folder}/empty.csv")
    assert none.columns == ["id", "cell"] and none.count() == 0


def test_csv_export_of_nested_columns(spark, folder):
    df = spark.sql("select 1 as id, array(named_struct('role', 'u', 'content', null)) as m")
    tables.write_table(df, folder, "n")
    assert tables.read_table(spark, f"{folder}/n.csv").first().m == '[{"role":"u","content":null}]'


def files_of_rows(spark, folder, sizes):
    """Parquet files with the given numbers of rows, in name order; n counts on."""
    start = 0
    path = f"{folder}/scan"
    for i, size in enumerate(sizes):
        part = spark.range(start, start + size, 1, 1).withColumnRenamed("id", "n")
        part.write.parquet(f"{folder}/part{i}")
        os.makedirs(path, exist_ok=True)
        (name,) = (f for f in os.listdir(f"{folder}/part{i}") if f.endswith(".parquet"))
        with open(f"{folder}/part{i}/{name}", "rb") as src, open(f"{path}/f{i:03}.parquet", "wb") as dst:
            dst.write(src.read())
        start += size
    return spark.read.parquet(path)


@pytest.mark.parametrize("small, per_scan", [(100_000, 1), (0, 1_000_000), (0, 1), (0, 2)])
def test_row_ids_count_on_over_files(spark, folder, small, per_scan):
    df = files_of_rows(spark, f"{folder}/a b%20ü", [5, 0, 20, 1, 9])
    work = WorkFolder(spark, folder)
    got = rw.assign_row_id(df, small_file_count=small, work=work, files_per_scan=per_scan)
    assert sorted((r.row_id, r.n) for r in got.collect()) == [(i, i) for i in range(35)]
    plan = got._jdf.queryExecution().executedPlan().toString()
    if not small:
        assert "Exchange" not in plan.replace("BroadcastExchange", "")
        assert "BroadcastHashJoin" in plan and ("Union" in plan) == (per_scan < 4)


def test_row_ids_beside_columns_of_any_name(spark, folder):
    df = files_of_rows(spark, folder, [3, 4])
    df.select("n", *(F.lit("x").alias(c) for c in ("_file", "_INDEX", "_base", "file"))).coalesce(1).write.parquet(
        f"{folder}/names"
    )
    named = spark.read.parquet(f"{folder}/names")
    for small in (100, 0):
        got = rw.assign_row_id(named, small_file_count=small, work=WorkFolder(spark, folder))
        assert got.columns == ["row_id", *named.columns]
        assert sorted(r.row_id for r in got.collect()) == list(range(7))


def test_hash_of_names_is_changed_until_it_tells_them_apart(spark, monkeypatch):
    names = spark.createDataFrame([(f"f{i}",) for i in range(4)], "file string")
    assert rw._telling_hash(names) == 0
    real, asked = F.xxhash64, []

    def poor(seed, name):
        asked.append(seed)
        return real(seed, name) % (1 if len(asked) < 3 else 1 << 40)

    monkeypatch.setattr(rw.F, "xxhash64", poor)
    assert rw._telling_hash(names) == 2


def test_first_rows(spark, folder):
    df = rw.assign_row_id(files_of_rows(spark, folder, [4, 4, 4]))
    for n, want in ((0, 12), (None, 12), (-3, 12), (5, 5), (99, 12)):
        assert rw.first_n(df, n).count() == want
    assert [r.n for r in rw.preview(df, 3).collect()] == [0, 1, 2]
    assert sorted(r.n for r in rw.rows_from(df, 9).collect()) == [9, 10, 11]
    assert rw.empty_like(df).count() == 0 and rw.empty_like(df).schema == df.schema


def test_head_reads_only_the_files_it_needs(spark, folder):
    df = files_of_rows(spark, folder, [4, 0, 4, 4, 4])
    for n in (1, 4, 5, 6, 8, 16, 99):
        assert sorted(r.n for r in rw.scan_head(df, n).collect()) == list(range(min(n, 16)))
    head = rw.scan_head(df, 6)
    assert "file_path" in head._jdf.queryExecution().optimizedPlan().toString()
    assert rw.scan_head(df.where("false"), 3).count() == 0


def test_head_opens_no_files_beyond_those_it_counts(spark, folder):
    """Of 2,000 files all but the first 20 are broken, so opening one more would fail."""
    os.makedirs(f"{folder}/many files")
    for i in range(2_000):
        path = f"{folder}/many files/f{i:05}.parquet"
        if i < 20:
            pq.write_table(pa.table({"n": pa.array([i], pa.int64())}), path)
        else:
            with open(path, "wb") as f:
                f.write(b"PAR1 nothing PAR1")
    df = spark.read.schema("n long").parquet(f"{folder}/many files")
    assert sorted(r.n for r in rw.scan_head(df, 10).collect()) == list(range(10))


@pytest.mark.parametrize("slices", [2, 3, 4096])
def test_lowest_rows_without_a_sort(spark, monkeypatch, slices):
    monkeypatch.setattr(rw, "SLICES", slices)
    values = [None, None, -(2**63), 2**63 - 1, *range(-50, 50, 3), 7, 7, 7, 0, 2**40]
    df = spark.createDataFrame([(v, i) for i, v in enumerate(values)], "row_id long, n long").repartition(3)
    order = sorted((v is not None, v or 0) for v in values)
    for n in (1, 2, 3, 4, 20, 22, 23, 24, 25, len(values) - 1, len(values), 999):
        cut = rw.lowest(df, n)
        got = sorted((r.row_id is not None, r.row_id or 0) for r in cut.collect())
        assert got == order[:n]
    unique = rw.lowest(df.where("n between 4 and 30"), 9)
    plan = unique._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Sort", "Limit", "SinglePartition"))
    assert rw.lowest(df.limit(0), 3).count() == 0


def test_small_tables_of_few_files_are_spread(spark, folder, monkeypatch):
    df = files_of_rows(spark, f"{folder}/with space", [40])
    assert rw.spread_small(df, "n").rdd.getNumPartitions() == 4
    assert rw.spread_small(spark.range(5), "id").rdd.getNumPartitions() == 4
    monkeypatch.setattr(rw, "SMALL_TABLE_BYTES", 10)
    assert rw.spread_small(df, "n") is df


@pytest.mark.parametrize("limit", [None, 0, 3, 100])
def test_splits(spark, folder, limit):
    df = spark.range(20).select("id", F.when(F.col("id") < 8, "test").otherwise("train").alias("s"))
    lake.write_splits(df.coalesce(1), folder, "org/d", "s")
    assert lake.split_names(spark, folder, "org/d") == ["test", "train"]
    assert lake.default_split(spark, folder, "org/d") == "train"
    got = lake.load_split(spark, folder, "org/d", "test", limit)
    assert sorted(r.id for r in got.collect()) == list(range(8))[: limit or None]
    assert lake.load_split(spark, folder, "org/d").count() == 12


def test_split_names_may_hold_any_signs(spark, folder):
    names = ["a:b/c", "ü %41", "x=[1]", "q'\\#?"]
    df = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "id int, s string")
    lake.write_splits(df, folder, "a:b/c", "s")
    assert lake.split_names(spark, folder, "a:b/c") == sorted(names)
    for i, n in enumerate(names):
        assert [r.id for r in lake.load_split(spark, folder, "a:b/c", n).collect()] == [i]


def test_missing_dataset_has_the_default_split(spark, folder):
    assert lake.split_names(spark, folder, "none") == ["train"]
    lake.write_splits(spark.range(1).withColumn("s", F.lit("b")), folder, "one", "s")
    assert lake.default_split(spark, folder, "one") == "b"


def test_reslice(spark, folder):
    df = spark.range(10).withColumnRenamed("id", "row_id")
    tables.write_table(df, folder, "t", csv=False)
    assert tables.reslice_cached(spark, folder, "t", 50).count() == 10
    assert tables.reslice_cached(spark, folder, "t", None).count() == 10
    assert tables.reslice_cached(spark, folder, "t", 4).count() == 4
    assert spark.read.parquet(f"{folder}/t.parquet").count() == 4
    assert os.listdir(folder) == ["t.parquet"]


def test_a_replacement_that_stopped_half_way_is_undone(spark, folder):
    df = spark.range(10).withColumnRenamed("id", "row_id")
    path = tables.write_table(df, folder, "t", csv=False)
    FileSystem(spark, path).rename(path, f"{path}.old")
    assert tables.reslice_cached(spark, folder, "t", 4).count() == 4


def test_catalog(spark, folder):
    tables.write_table(odd(spark), folder, "b/odd")
    tables.write_table(spark.range(7), folder, "a", csv=False)
    tables.write_table(spark.range(0), folder, "empty", csv=False)
    tables.write_table(spark.range(3), folder, "with space", csv=False)
    os.makedirs(f"{folder}/broken.parquet")
    with open(f"{folder}/broken.parquet/x.parquet", "w") as f:
        f.write("no parquet")
    with pytest.warns(UserWarning, match="broken"):
        found = tables.catalog(spark, folder)
    assert [(r.name, r.columns, r.row_count) for r in found.collect()] == [
        ("a", ["id"], 7),
        ("b_odd", ["row_id", "cell"], len(ODD_CELLS)),
        ("empty", ["id"], 0),
        ("with space", ["id"], 3),
    ]
    assert tables.catalog(spark, f"{folder}/nothing").count() == 0


def test_publish(spark, folder):
    path = tables.write_table(odd(spark), folder, "t", csv=False)
    ok, target = publish.publish(spark, path, f"{folder}/out", "org/src", "de")
    assert ok and target == f"{folder}/out"
    assert spark.read.parquet(f"{target}/data").count() == len(ODD_CELLS)
    card = "\n".join(r.value for r in spark.read.text(f"{target}/README.md").collect())
    assert "language: de" in card and "| cell | string | 8 | 8 |" in card
    ok, why = publish.publish(spark, f"{folder}/gone.parquet", f"{folder}/out2", "org/src")
    assert not ok and "gone" in why
    assert publish.publish(spark, path, " ", "org/src") == (False, "no target given")


def test_limit_of_a_split_of_a_numbered_table(spark, folder):
    df = spark.range(30).select(
        F.col("id").alias("row_id"), F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("split")
    )
    lake.write_splits(df, folder, "org/d", "split")
    got = lake.load_split(spark, folder, "org/d", "a", 5)
    assert sorted(r.row_id for r in got.collect()) == [0, 3, 6, 9, 12]


def test_catalog_leaves_out_a_table_with_a_broken_file(spark, folder):
    for name in ("good", "broken"):
        tables.write_table(spark.range(10).repartition(2), folder, name, csv=name == "good")
    parts = [p for p in os.listdir(f"{folder}/broken.parquet") if p.endswith(".parquet")]
    with open(f"{folder}/broken.parquet/{parts[0]}", "wb") as f:
        f.write(b"PAR1 nothing PAR1")
    tables.write_csv(spark.range(4), f"{folder}/only.csv")
    with pytest.warns(UserWarning, match="broken"):
        rows = tables.catalog(spark, folder).collect()
    assert [(r["name"], r["row_count"]) for r in rows] == [("good", 10), ("only", 4)]


def test_reslice_of_a_table_without_positions(spark, folder):
    tables.write_table(spark.range(50).coalesce(1), folder, "t")
    assert tables.reslice_cached(spark, folder, "t", 7).count() == 7
    assert tables.reslice_cached(spark, folder, "t", 20).count() == 7


def test_publish_says_why_it_failed(spark, folder):
    df = spark.range(3).withColumn("cell", F.raise_error(F.lit("no such cell")))
    ok, why = publish.publish(spark, df, f"{folder}/out", "org/src")
    assert not ok and "could not publish" in why


def test_card_is_a_file(spark, folder):
    path = publish.publish_card(spark, "# Card\n\ntext\n", folder)
    publish.publish_card(spark, "# Card\n\nnew\n", folder)
    with open(path, encoding="utf-8") as f:
        assert f.read() == "# Card\n\nnew\n"
    assert not [n for n in os.listdir(folder) if n.startswith(".README") and "crc" not in n]
