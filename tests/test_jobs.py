"""States of jobs."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from glossa.plans import jobs


def states(spark):
    return spark.createDataFrame(
        [("a", 10, 0, None), ("b", 10, 4, "2024-01-02"), ("c", 10, 10, "2024-05-01"),
         ("d", 0, 0, None), ("e", 9, 1, "2024-03-01")],
        "job string, total_rows long, completed_rows long, updated_at string",
    ).withColumn("updated_at", F.to_timestamp("updated_at"))


def test_pending(spark):
    flags = {r.job: r.has_pending for r in jobs.with_pending(states(spark)).collect()}
    assert flags == {"a": False, "b": True, "c": False, "d": False, "e": True}
    assert {r.job for r in jobs.pending_jobs(states(spark)).collect()} == {"a", "b", "e"}


def test_latest_pending(spark):
    assert jobs.latest_pending(states(spark), ["job"]).first().job == "e"
    only_null = states(spark).where("job in ('a', 'c')")
    assert jobs.latest_pending(only_null, ["job"]).first().job == "a"
    saved = spark.createDataFrame([("a",), ("b",)], "job string")
    assert jobs.latest_pending(states(spark), ["job"], saved).count() == 0
    assert jobs.latest_pending(states(spark), ["job"], states(spark)).first().job == "e"


def test_progress(spark):
    got = {r.job: (r.progress, r.status) for r in jobs.with_progress(states(spark)).collect()}
    assert got["a"] == (0.0, "idle") and got["b"] == (0.4, "running")
    assert got["c"] == (1.0, "completed") and got["d"] == (0.0, "completed")


def test_derived_state(spark):
    inputs = spark.range(10).selectExpr("id as row_id", "if(id < 6, 'a', 'b') as job")
    done = inputs.where("row_id in (0, 1, 3)")
    got = {r.job: r for r in jobs.job_states(inputs, done, ["job"]).collect()}
    assert (got["a"].total_rows, got["a"].completed_rows, got["a"].last_saved_row) == (6, 3, 3)
    assert (got["b"].total_rows, got["b"].completed_rows, got["b"].last_saved_row) == (4, 0, -1)
    assert got["b"].updated_at is None
    left = jobs.remaining(inputs, done)
    assert sorted(r.row_id for r in left.collect()) == [2, 4, 5, 6, 7, 8, 9]


def test_summary(spark):
    made = jobs.job_summary(states(spark), F.lit("d"), F.col("job"), ["x", "y"], "en", "tr")
    got = {r.job: r.summary for r in made.collect()}
    assert got["b"] == (
        "Dataset: d | Split: b | Rows: 10\nColumns: x, y\nLanguage: en -> tr\n"
        "Pending job: 4/10 rows done"
    )
    assert "Pending" not in got["a"]


def test_import_of_state_records(spark, folder):
    records = {
        "good": json.dumps({"dataset_id": "d", "split": "s", "columns": ["c"], "total_rows": 9,
                            "completed_rows": 4, "last_saved_row": 3,
                            "timestamp": "2024-01-02T03:04:05+00:00"}),
        "corrupt": '{"dataset_id": "x", ',
        "bare": json.dumps({"dataset_id": "e"}, indent=2),
        "foreign": "[1, 2]",
    }
    for name, text in records.items():
        with open(f"{folder}/{name}.json", "w") as f:
            f.write(text)
    got = {r.dataset_id: r for r in jobs.import_states(spark, folder).collect()}
    assert set(got) == {"d", "e"}
    assert (got["d"].completed_rows, got["d"].columns) == (4, ["c"])
    assert got["d"].updated_at is not None
    assert (got["e"].split, got["e"].completed_rows, got["e"].last_saved_row) == ("train", 0, -1)
