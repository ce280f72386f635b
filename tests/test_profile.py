"""Column counts, JSON shape, reports."""

from __future__ import annotations

import hashlib
import json
import pytest
from pyspark.sql import functions as F

from glossa.operators.rows import first_n
from glossa.operators import cells, profile


def sample(spark):
    return spark.createDataFrame(
        [
            (0, '[{"role":"u","content":"a"},{"content":"b"}]', 1.0, "x"),
            (1, '{"text":["bare"]}', float("nan"), "x"),
            (2, "plain", None, None),
            (3, None, -0.0, "y" * 100),
            (4, "plain", 0.0, "y" * 100),
        ],
        "row_id long, cell string, score double, label string",
    )


@pytest.mark.parametrize("approx", [False, True])
def test_column_stats(spark, approx):
    got = profile.column_stats(sample(spark).repartition(3), approx).orderBy("position").collect()
    assert [tuple(r) for r in got] == [
        (0, "row_id", "bigint", 5, 5),
        (1, "cell", "string", 4, 3),
        (2, "score", "double", 3, 2),
        (3, "label", "string", 4, 2),
    ]


def test_stats_of_an_empty_table(spark):
    got = profile.column_stats(sample(spark).limit(0)).collect()
    assert {(r.column, r.non_null, r.distinct_values) for r in got} == {
        (c, 0, 0) for c in ("row_id", "cell", "score", "label")
    }


def test_json_profile_and_keys(spark):
    df = sample(spark)
    got = {r.column: (r.total_rows, r.json_rows) for r in profile.json_profile(df).collect()}
    assert got == {"cell": (5, 2), "label": (5, 0)}
    first = profile.json_profile(first_n(df, 1)).where("column = 'cell'").first()
    assert (first.total_rows, first.json_rows) == (1, 1)
    keys = profile.json_key_table(df)
    assert {tuple(r) for r in keys.collect()} == {("cell", k) for k in ("content", "role", "text")}


def test_a_key_in_both_lists_shows_in_both(spark):
    keys = spark.createDataFrame([("c", "a"), ("c", "b"), ("c", "z")], "column string, key string")
    got = profile.classify_keys(keys, ("a", "b"), ("b",)).collect()
    assert sorted((r.key, r.kind) for r in got) == [
        ("a", "translate"),
        ("b", "skip"),
        ("b", "translate"),
        ("z", "untouched"),
    ]


def test_column_report(spark):
    lines = profile.column_report(sample(spark)).orderBy("column", "section", "part").collect()
    assert [r.line for r in lines] == [
        "cell: JSON detected (2/5 rows)",
        "Translate: content, text",
        "Skip: role",
        "label: plain text",
    ]


def test_long_key_lists_are_spread_and_whole(spark):
    df = spark.range(1000).select(
        F.col("id").alias("row_id"),
        F.concat(F.lit('{"k'), F.col("id"), F.lit('": 1}')).alias("cell"),
    )
    lines = profile.column_report(df).where("section = 3").collect()
    keys = [k for r in lines for k in r.line.removeprefix("Untouched: ").split(", ")]
    assert sorted(keys) == sorted(f"k{i}" for i in range(1000))
    assert len(lines) == 5


def test_no_text_columns(spark):
    with pytest.raises(ValueError, match="no text columns"):
        profile.json_profile(spark.range(3).withColumnRenamed("id", "row_id"))


def test_dataset_card(spark):
    card = profile.dataset_card(sample(spark), "out", "org/src", "de")
    assert card.startswith("---\nlanguage: de\nlicense: mit\n---\n\n# out\n")
    assert "| column | type | filled cells | different values |\n| --- | --- | --- | --- |\n" in card
    assert "| score | double | 3 | 2 |" in card
    assert "Rows of `org/src`" in card and "language is `de`" in card
    assert card.count("\n| plain |") == 1 and "row_id" not in card


def test_choosing_columns(spark):
    df = sample(spark)
    assert cells.text_columns(df) == ["cell", "label"]
    assert cells.select_columns(df, ["label", "cell"]).columns == ["label", "cell"]
    assert cells.columns_summary(["a", "b"]) == "2 column(s) selected: a, b"
    assert cells.columns_summary([]) == "No columns selected"
    for wrong in ([], ["gone"]):
        with pytest.raises(ValueError):
            cells.chosen_columns(df, wrong)


def test_replace_columns_keeps_order(spark):
    out = cells.replace_columns(sample(spark), {"score": F.lit("s")})
    assert out.columns == ["row_id", "cell", "score", "label"]
    assert {r.score for r in out.collect()} == {"s"}


def test_unpivot_turns_nested_values_into_json(spark):
    df = spark.sql(
        "select 1L as row_id, array(named_struct('role', 'u', 'content', null)) as m, 5 as n, "
        "cast(null as string) as t"
    )
    got = cells.unpivot_cells(df, "row_id", ["m", "n", "t"]).collect()
    assert {(r.column, r.cell) for r in got} == {
        ("m", '[{"role":"u","content":null}]'),
        ("n", "5"),
        ("t", None),
    }


def test_a_long_value_is_not_its_digest(spark):
    long = "x" * 100
    digest = hashlib.sha256(long.encode()).hexdigest()
    df = spark.createDataFrame([(long,), (digest,), ("#" + digest,), (long,)], "cell string")
    assert profile.column_stats(df).first().distinct_values == 3


def test_many_keys_are_listed_in_order(spark):
    cell = json.dumps({f"k{i:03d}": 1 for i in range(500)})
    lines = profile.column_report(spark.createDataFrame([(cell,)], "cell string"))
    keys = [r.line for r in lines.where("section = 3").orderBy("part").collect()]
    assert len(keys) == 3
    assert ", ".join(k.removeprefix("Untouched: ") for k in keys) == ", ".join(
        f"k{i:03d}" for i in range(500)
    )


@pytest.mark.parametrize("ids", [[100, 101, 102, 103], ["b", "a", "d", "c"]])
def test_card_shows_the_first_rows_of_any_ids(spark, ids):
    df = spark.createDataFrame([(i, f"cell-{i}") for i in ids]).toDF("row_id", "cell")
    card = profile.dataset_card(df, "d", "src")
    assert [f"cell-{i}" in card for i in sorted(ids)] == [True, True, True, False]
