"""Translation: faults, memory, batches, resuming, streams."""

from __future__ import annotations

import io
import json
import os
import sys
import threading
import time
import urllib.error
from dataclasses import dataclass, replace
from typing import Any

import pyarrow as pa
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from glossa import backends
from glossa.backends import (
    BackendError,
    ChatBackend,
    EchoBackend,
    FatalBackendError,
    FaultyBackend,
    Request,
    StubBackend,
)
from glossa.operators import inference
from glossa.plans import dataset as ds
from glossa.plans import jobs
from glossa.plans import translate as tr
from glossa.session import WorkFolder
from glossa.settings import JobParams
from glossa.streaming.incremental import translate_stream

# The tasks cannot import this module, so its classes are sent to them.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

QUICK = JobParams(max_tokens=128, retry_wait=0.0)


@dataclass
class Counting:
    """The stub, counting its calls over all tasks."""

    calls: Any

    def complete(self, request):
        self.calls.add(1)
        return StubBackend().complete(request)


@pytest.fixture
def counting(spark):
    return Counting(spark.sparkContext.accumulator(0))


def engine(spark, folder, backend=None, params=QUICK, **more):
    work = WorkFolder(spark, folder)
    memory = inference.TranslationMemory(spark, f"{folder}/memory")
    return tr.Engine(backend or StubBackend(), params, memory, work, **more)


LONG = " ".join(f"This is sentence number {i}." for i in range(40))
CHAT = '[{"role":"user","content":"hi"},{"role":"assistant","content":"%s"}]' % LONG


def cells(spark):
    return spark.createDataFrame(
        [
            (0, "plain", "keep", 1.5),
            (1, CHAT, None, 2.5),
            (2, None, "keep", None),
            (3, "   ", "k", 0.0),
            (4, LONG, "k", 0.0),
            (5, '{"k": 69}', "k", 0.0),
            (6, '{"a":1} x', "k", 0.0),
        ],
        "row_id long, cell string, other string, score double",
    )


def by_id(df, column="cell"):
    return {r["row_id"]: r[column] for r in df.collect()}


def stub_of(text):
    from glossa.functions.deep import deep_chunks
    from glossa.settings import char_budget

    parts = deep_chunks(text, char_budget(QUICK.max_tokens))
    return " ".join(f"[tr] {p}" for p in parts)


def test_translate_rows(spark, folder):
    out = tr.translate_rows(cells(spark), ["cell"], engine(spark, folder))
    assert out.columns == ["row_id", "cell", "other", "score", "failed_chunks"]
    got = by_id(out)
    assert got[0] == "[tr] plain" and got[2] is None and got[3] == "   "
    assert got[4] == stub_of(LONG) and got[4].count("[tr]") > 1
    assert got[5] == '{\n  "k": 69\n}' and got[6] == '[tr] {"a":1} x'
    assert json.loads(got[1]) == [
        {"role": "user", "content": "[tr] hi"},
        {"role": "assistant", "content": stub_of(LONG)},
    ]
    assert by_id(out, "other") == by_id(cells(spark), "other")
    assert by_id(out, "score") == by_id(cells(spark), "score")


def test_json_mode_off_takes_json_as_text(spark, folder):
    params = JobParams(max_tokens=128, json_mode="off")
    out = by_id(tr.translate_rows(cells(spark), ["cell"], engine(spark, folder, params=params)))
    assert out[5] == '[tr] {"k": 69}'


def test_force_and_auto_agree(spark, folder):
    force = JobParams(max_tokens=128, json_mode="force")
    a = tr.translate_rows(cells(spark), ["cell"], engine(spark, f"{folder}/a"))
    b = tr.translate_rows(cells(spark), ["cell"], engine(spark, f"{folder}/b", params=force))
    assert by_id(a) == by_id(b)


def test_own_key_lists(spark, folder):
    params = JobParams(translate_keys=("a",), skip_keys=("b",))
    df = spark.createDataFrame(
        [(0, '{"a":"x","b":{"a":"y"},"content":"z"}')], "row_id long, cell string"
    )
    out = tr.translate_rows(df, ["cell"], engine(spark, folder, params=params)).first().cell
    assert json.loads(out) == {"a": "[tr] x", "b": {"a": "y"}, "content": "z"}


def test_several_columns_and_other_types(spark, folder):
    df = spark.sql(
        "select 7L as row_id, 5 as n, 'a' as `odd.name`, array(named_struct('role', 'u', "
        "'content', 'hi')) as m, true as flag"
    )
    out = tr.translate_rows(df, ["m", "odd.name", "n"], engine(spark, folder)).first()
    assert out["n"] == "[tr] 5" and out["odd.name"] == "[tr] a" and out["flag"] is True
    assert json.loads(out["m"]) == [{"role": "u", "content": "[tr] hi"}]


def test_order_of_rows_and_partitions_does_not_matter(spark, folder):
    a = by_id(tr.translate_rows(cells(spark), ["cell"], engine(spark, f"{folder}/a")))
    shuffled = cells(spark).orderBy(F.rand(3)).repartition(5)
    e = engine(spark, f"{folder}/b", chunks_per_task=1)
    b = by_id(tr.translate_rows(e.work.write(shuffled, "in"), ["cell"], e))
    assert a == b


def test_an_echo_changes_nothing_but_the_form_of_json(spark, folder):
    out = by_id(tr.translate_rows(cells(spark), ["cell"], engine(spark, folder, EchoBackend())))
    for i, cell in by_id(cells(spark)).items():
        same = out[i] == cell
        assert same or json.loads(out[i]) == json.loads(cell)


# --------------------------------------------------------------------- faults


def statuses(spark, backend, texts, **more):
    df = spark.createDataFrame([(t,) for t in texts], "chunk string")
    done = inference.translate_chunks(df, backend, QUICK, **more).collect()
    return {r.chunk: (r.tgt, r.status, r.attempts) for r in done}


@pytest.mark.parametrize("in_flight", [1, 4])
def test_statuses(spark, in_flight):
    backend = FaultyBackend(soft="S", empty="E", flaky="F")
    got = statuses(spark, backend, ["S1", "E1", "F1", "ok", " ", None], in_flight=in_flight)
    assert got == {
        "S1": (None, "failed", 3),
        "E1": (None, "failed", 3),
        "F1": ("[tr] F1", "ok", 3),
        "ok": ("[tr] ok", "ok", 1),
        " ": (" ", "skipped", 0),
        None: (None, "skipped", 0),
    }


def test_waits_grow_between_tries(monkeypatch):
    waits = []
    monkeypatch.setattr(inference.time, "sleep", waits.append)
    assert inference._attempt(FaultyBackend(soft="x"), "x", JobParams()) == (None, "failed", 3)
    assert waits == [2.0, 4.0]


def test_a_failed_chunk_keeps_the_whole_cell(spark, folder):
    backend = FaultyBackend(soft="number 20.")
    e = engine(spark, folder, backend)
    out = tr.translate_rows(cells(spark), ["cell"], e)
    got, failed = by_id(out), by_id(out, "failed_chunks")
    assert got[4] == LONG and got[0] == "[tr] plain"
    assert json.loads(got[1])[0]["content"] == "[tr] hi"
    assert json.loads(got[1])[1]["content"] == LONG
    assert failed == {0: 0, 1: 1, 2: 0, 3: 0, 4: 1, 5: 0, 6: 0}


def test_all_chunks_fail(spark, folder):
    out = tr.translate_rows(
        cells(spark), ["cell"], engine(spark, folder, FaultyBackend(empty=""))
    )
    assert by_id(out)[4] == LONG and by_id(out)[0] == "plain"


def test_fatal_errors_stop_the_job(spark, folder):
    e = engine(spark, folder, FaultyBackend(fatal="plain"))
    with pytest.raises(Exception, match="Failed to load model"):
        tr.translate_rows(cells(spark), ["cell"], e).collect()


def test_canary(spark, folder):
    with pytest.raises(FatalBackendError):
        tr.require_backend(spark, engine(spark, folder, FaultyBackend(empty="Hello")))
    tr.require_backend(spark, engine(spark, folder))


# --------------------------------------------------------------------- memory


def test_every_distinct_chunk_is_translated_once(spark, folder, counting):
    df = spark.range(100).select(
        F.col("id").alias("row_id"), F.concat(F.lit("text "), F.col("id") % 7).alias("cell")
    )
    first = tr.translate_rows(df, ["cell"], engine(spark, folder, counting))
    assert len({r.cell for r in first.collect()}) == 7
    assert counting.calls.value == 7
    again = tr.translate_rows(df, ["cell"], engine(spark, folder, counting))
    assert by_id(again) == by_id(first)
    assert counting.calls.value == 7
    other = JobParams(max_tokens=128, target_lang="de")
    tr.translate_rows(df, ["cell"], engine(spark, folder, counting, other)).collect()
    assert counting.calls.value == 14


def test_a_key_stored_twice_gives_no_second_row(spark, folder):
    e = engine(spark, folder)
    df = cells(spark)
    tr.translate_rows(df, ["cell"], e)
    stored = e.memory.rows().select("key", F.col("src").alias("chunk"), "tgt", "status", "attempts")
    e.memory.append(e.work.write(stored, "copy"), e.params)
    assert tr.translate_rows(df, ["cell"], e.fresh()).count() == df.count()


def test_failures_are_not_reused(spark, folder):
    df = spark.createDataFrame([(0, "bad")], "row_id long, cell string")
    bad = tr.translate_rows(df, ["cell"], engine(spark, folder, FaultyBackend(soft="bad")))
    assert by_id(bad) == {0: "bad"}
    good = tr.translate_rows(df, ["cell"], engine(spark, folder))
    assert by_id(good) == {0: "[tr] bad"}


def hot_table(spark):
    return spark.range(2000).select(
        F.col("id").alias("row_id"),
        F.when(F.col("id") % 3 == 0, "the same").otherwise(F.concat(F.lit("t"), "id")).alias("cell"),
    )


def test_hot_keys_are_found_and_spread(spark, folder):
    df = hot_table(spark)
    keyed = df.withColumn("key", inference.chunk_key("cell", QUICK))
    hot = inference.hot_salts(keyed, 2000, min_rows=50)
    assert [n for _, n in hot] == [-(-667 // 50)]
    assert inference.hot_salts(keyed, 2000) == []
    known = keyed.select("key", F.upper("cell").alias("tgt")).distinct()
    plain = inference.attach_translations(keyed.select("row_id", "key"), known, [])
    salted = inference.attach_translations(keyed.select("row_id", "key"), known, hot)
    assert plain.exceptAll(salted.select(plain.columns)).count() == 0
    assert salted.count() == 2000


@pytest.mark.parametrize("keys", [0, 10**6])
def test_memory_lookup_with_few_or_many_keys(spark, folder, keys, counting):
    e = engine(spark, folder, counting, broadcast_keys=keys)
    tr.translate_rows(cells(spark), ["cell"], e).collect()
    calls = counting.calls.value
    assert calls == e.memory.rows().count()
    more = cells(spark).unionByName(cells(spark).withColumn("row_id", F.col("row_id") + 100))
    again = e.fresh()
    out = by_id(tr.translate_rows(again.work.write(more, "in"), ["cell"], again))
    assert counting.calls.value == calls
    assert all(out[i] == out[i + 100] for i in range(7)) and out[4] == stub_of(LONG)


def test_hot_keys_give_the_same_result(spark, folder):
    a = tr.translate_rows(hot_table(spark), ["cell"], engine(spark, f"{folder}/a"))
    b = tr.translate_rows(
        hot_table(spark), ["cell"], engine(spark, f"{folder}/b", hot_min_rows=10)
    )
    assert by_id(a) == by_id(b)
    assert "salt" in b._jdf.queryExecution().optimizedPlan().toString()


def test_results_are_committed_in_slices(spark, folder, counting):
    e = engine(spark, folder, counting, commit_chunks=300)
    out = tr.translate_rows(hot_table(spark), ["cell"], e)
    assert by_id(out) == {r.row_id: f"[tr] {r.cell}" for r in hot_table(spark).collect()}
    assert counting.calls.value == 1334
    bad = engine(spark, f"{folder}/b", FaultyBackend(fatal="t1999"), commit_chunks=300)
    with pytest.raises(Exception, match="Failed to load model"):
        tr.translate_rows(hot_table(spark), ["cell"], bad)
    kept = bad.memory.rows().count()
    again = engine(spark, f"{folder}/b", counting, commit_chunks=300)
    assert by_id(tr.translate_rows(hot_table(spark), ["cell"], again)) == by_id(out)
    assert 0 < kept == 2 * 1334 - counting.calls.value


def test_column_names_may_be_any(spark, folder):
    df = spark.sql("select 'r1' as key, 'a' as text, 'b' as column, 'c' as cell, 'd' as chunk")
    out = tr.translate_rows(df, ["text", "column", "chunk"], engine(spark, folder), "key").first()
    assert tuple(out) == ("r1", "[tr] a", "[tr] b", "c", "[tr] d", 0)
    with pytest.raises(ValueError, match="already has"):
        tr.translate_rows(df.withColumn(tr.FAILED, F.lit(1)), ["text"], engine(spark, folder), "key")


# ------------------------------------------------------------ datasets, resume


def job(**more):
    return ds.Job("org/d", "train", ("cell",), QUICK, **more)


def stored(spark, folder, one=None):
    return by_id(spark.read.parquet(ds.output_path(folder, one or job())))


def many(spark, n=20):
    return spark.range(n).select(
        F.col("id").alias("row_id"), F.concat(F.lit("row "), "id").alias("cell"), F.lit(1).alias("x")
    )


def test_dataset_in_batches(spark, folder):
    seen = []
    path = ds.translate_dataset(
        many(spark), job(), engine(spark, folder), folder, batch_rows=8,
        on_progress=lambda *a: seen.append(a),
    )
    assert path == ds.output_path(folder, job())
    assert stored(spark, folder) == {i: f"[tr] row {i}" for i in range(20)}
    ends = [(d, t) for d, t, what in seen if "commit" not in what]
    assert ends == [(0, 20), (8, 20), (8, 20), (16, 20), (16, 20), (20, 20)]
    assert sum("commit 1 of 1" in what for _, _, what in seen) == 3
    assert ds.read_output(spark, folder, job()).columns == ["cell", "x"]


def test_stop_and_go_on(spark, folder, counting):
    e = engine(spark, folder, counting)
    df = many(spark)
    ds.translate_dataset(df, job(), e, folder, batch_rows=5, max_batches=2, check_backend=False)
    assert sorted(stored(spark, folder)) == list(range(10))
    state = ds.job_state(df, job(), folder).first()
    assert (state.total_rows, state.completed_rows, state.last_saved_row) == (20, 10, 9)
    assert state.updated_at is not None
    ds.translate_dataset(df, job(), e, folder, batch_rows=5, check_backend=False)
    assert stored(spark, folder) == {i: f"[tr] row {i}" for i in range(20)}
    assert counting.calls.value == 20
    ds.translate_dataset(df, job(), e, folder, check_backend=False)
    assert spark.read.parquet(ds.output_path(folder, job())).count() == 20


def test_positions_may_be_text(spark, folder):
    df = many(spark, 5).withColumn("row_id", F.concat(F.lit("r"), "row_id"))
    e = engine(spark, folder)
    ds.translate_dataset(df.where("row_id < 'r2'"), job(), e, folder)
    ds.translate_dataset(df, job(), e, folder, batch_rows=2)
    assert stored(spark, folder) == {f"r{i}": f"[tr] row {i}" for i in range(5)}


def test_finished_batches_are_not_read_again(spark, folder):
    e = engine(spark, folder)
    df = many(spark)
    ds.translate_dataset(df.where("row_id < 7"), job(), e, folder)
    done = ds.stored_output(spark, ds.output_path(folder, job()), df, job().columns)
    batches, finished, total = ds._batches(df, done, "row_id", 5)
    assert [label for label, _ in batches] == ["batch 1", "batch 2", "batch 3"]
    assert (finished, total) == (7, 20)
    plans = [t._jdf.queryExecution().optimizedPlan().toString() for _, t in batches]
    assert ["LeftAnti" in p for p in plans] == [True, False, False]


def test_holes_are_filled(spark, folder):
    e = engine(spark, folder)
    ds.append_batch(many(spark, 5).where("row_id in (0, 1, 3)"), ["cell"], e, ds.output_path(folder, job()))
    ds.translate_dataset(many(spark, 5), job(), e, folder)
    assert sorted(stored(spark, folder)) == [0, 1, 2, 3, 4]


def test_start_row_replaces(spark, folder):
    e = engine(spark, folder)
    ds.translate_dataset(many(spark), job(), e, folder)
    new = many(spark).withColumn("cell", F.concat(F.lit("new "), "row_id"))
    ds.translate_dataset(new, job(), e, folder, start_row=15)
    got = stored(spark, folder)
    assert got[14] == "[tr] row 14" and got[15] == "[tr] new 15" and len(got) == 20
    assert spark.read.parquet(ds.output_path(folder, job())).count() == 20
    ds.translate_dataset(new, job(), e, folder, start_row=0)
    assert set(stored(spark, folder).values()) == {f"[tr] new {i}" for i in range(20)}


def test_failed_rows_are_tried_again_if_asked(spark, folder):
    bad = engine(spark, folder, FaultyBackend(soft="row 3"))
    ds.translate_dataset(many(spark, 5), job(), bad, folder)
    good = engine(spark, folder)
    ds.translate_dataset(many(spark, 5), job(), good, folder)
    assert stored(spark, folder)[3] == "row 3"
    ds.translate_dataset(many(spark, 5), job(), good, folder, retry_failed=True)
    assert stored(spark, folder)[3] == "[tr] row 3" and len(stored(spark, folder)) == 5


def test_start_row_with_retry_loses_no_row(spark, folder):
    bad = engine(spark, folder, FaultyBackend(soft="row 3"))
    ds.translate_dataset(many(spark), job(), bad, folder)
    good = engine(spark, folder)
    ds.translate_dataset(many(spark), job(), good, folder, start_row=10, retry_failed=True)
    assert stored(spark, folder) == {i: f"[tr] row {i}" for i in range(20)}
    assert spark.read.parquet(ds.output_path(folder, job())).count() == 20


@pytest.mark.parametrize("ids", ["(1L << 60) + id * id * 1000003", "xxhash64(id)", "id - 5"])
def test_any_ids_in_batches(spark, folder, ids):
    df = many(spark).withColumn("id", F.col("row_id")).withColumn("row_id", F.expr(ids.replace("1L << 60", "1152921504606846976L")))
    e = engine(spark, folder)
    seen = []
    ds.translate_dataset(df.drop("id"), job(), e, folder, batch_rows=7, on_progress=lambda *a: seen.append(a))
    got = stored(spark, folder)
    assert got == {r.row_id: f"[tr] row {r.id}" for r in df.collect()}
    assert len({what for _, _, what in seen if what.endswith("done")}) <= 3


def test_output_stays_until_the_new_rows_are_there(spark, folder):
    ds.translate_dataset(many(spark), job(), engine(spark, folder), folder)
    new = many(spark).withColumn("cell", F.concat(F.lit("new "), "row_id"))
    bad = engine(spark, folder, FaultyBackend(fatal="new 17"))
    with pytest.raises(Exception, match="Failed to load model"):
        ds.translate_dataset(new, job(), bad, folder, start_row=5, batch_rows=5)
    assert stored(spark, folder) == {i: f"[tr] row {i}" for i in range(20)}
    ds.translate_dataset(new, job(), engine(spark, folder), folder, start_row=5, batch_rows=5)
    got = stored(spark, folder)
    assert got == {i: f"[tr] {'row' if i < 5 else 'new'} {i}" for i in range(20)}


def test_work_tables_of_a_failed_batch_are_dropped(spark, folder):
    bad = engine(spark, folder, FaultyBackend(fatal="row 3"))
    before = {p for p, _, names in os.walk(bad.work.root) if names}
    with pytest.raises(Exception, match="Failed to load model"):
        ds.translate_dataset(many(spark), job(), bad, folder)
    assert {p for p, _, names in os.walk(bad.work.root) if names} == before


def test_stop_signal_between_commits(spark, folder, counting):
    e = engine(spark, folder, counting, commit_chunks=5)
    asked = []

    def stop():
        asked.append(1)
        return len(asked) > 2

    path = ds.translate_dataset(many(spark), job(), e, folder, check_backend=False, should_stop=stop)
    assert not os.path.exists(path) and 0 < counting.calls.value < 20
    ds.translate_dataset(many(spark), job(), e, folder, check_backend=False)
    assert stored(spark, folder) == {i: f"[tr] row {i}" for i in range(20)}
    assert counting.calls.value == 20


def test_requests_stay_within_the_bound(spark, folder):
    e = engine(spark, folder, in_flight=4, chunks_per_task=1, max_requests=6)
    assert e.tasks(1000) * e.calls <= 6
    assert replace(e, max_requests=2).tasks(1000) * replace(e, max_requests=2).calls <= 2


def test_two_results_of_one_engine(spark, folder):
    e = engine(spark, folder)
    first = tr.translate_plain(many(spark), "cell", e)
    other = many(spark).withColumn("cell", F.concat(F.lit("other "), "row_id"))
    second = tr.translate_plain(other, "cell", e)
    assert second.count() == 20
    assert {r.translation for r in first.collect()} == {f"[tr] row {i}" for i in range(20)}


def test_numbers_and_nested_values_become_text(spark, folder):
    one = ds.Job("org/d", "train", ("n", "m"), QUICK)
    df = spark.range(6).selectExpr(
        "id as row_id", "id * 10 as n", "array(named_struct('role', 'u', 'content', 'c')) as m"
    )
    ds.translate_dataset(df, one, engine(spark, folder, FaultyBackend(soft="30")), folder)
    ds.translate_dataset(df, one, engine(spark, folder), folder, start_row=5)
    ds.translate_dataset(df, one, engine(spark, folder), folder, retry_failed=True)
    out = spark.read.parquet(ds.output_path(folder, one))
    assert by_id(out, "n") == {i: f"[tr] {i * 10}" for i in range(6)}
    assert json.loads(out.first().m) == [{"role": "u", "content": "[tr] c"}]


def test_committed_batches_survive_a_fatal_error(spark, folder):
    e = engine(spark, folder, FaultyBackend(fatal="row 12"))
    with pytest.raises(Exception, match="Failed to load model"):
        ds.translate_dataset(many(spark), job(), e, folder, batch_rows=5)
    assert sorted(stored(spark, folder)) == list(range(10))


def test_restart_and_other_jobs(spark, folder):
    e = engine(spark, folder)
    other = ds.Job("org/d", "train", ("cell",), JobParams(max_tokens=128, target_lang="de"))
    assert ds.output_path(folder, job()) != ds.output_path(folder, other)
    ds.translate_dataset(many(spark, 3), job(), e, folder)
    ds.translate_dataset(
        many(spark, 3), other, engine(spark, folder, params=other.params), folder
    )
    ds.restart(spark, folder, job())
    assert ds.job_state(many(spark, 3), job(), folder).first().completed_rows == 0
    assert len(stored(spark, folder, other)) == 3


def test_states_of_several_jobs(spark, folder):
    other = ds.Job("org/d", "test", ("cell",), QUICK)
    third = ds.Job("org/e", "test", ("cell", "x"), QUICK)
    e = engine(spark, folder)
    ds.translate_dataset(many(spark, 9), job(), e, folder, batch_rows=5, max_batches=1)
    ds.translate_dataset(many(spark, 4), other, e, folder)
    given = [(job(), many(spark, 9)), (other, many(spark, 4)), (third, many(spark, 2))]
    states = ds.all_states(given, folder)
    got = {(r.dataset_id, r.split): r for r in states.collect()}
    assert {k: (r.completed_rows, r.total_rows) for k, r in got.items()} == {
        ("org/d", "train"): (5, 9), ("org/d", "test"): (4, 4), ("org/e", "test"): (0, 2),
    }
    assert got["org/e", "test"].columns == ["cell", "x"]
    by = ["dataset_id", "split"]
    assert jobs.pending_jobs(states).count() == 2
    assert jobs.latest_pending(states, by).first().split == "train"


def test_a_batch_without_rows(spark, folder):
    none = spark.createDataFrame([], many(spark, 0).schema)
    counted = ds.append_batch(none, ["cell"], engine(spark, folder), f"{folder}/out")
    assert (counted["rows"] or 0) == 0


def test_an_empty_dataset_has_an_empty_output(spark, folder):
    ds.translate_dataset(many(spark, 0), job(), engine(spark, folder), folder)
    out = ds.read_output(spark, folder, job())
    assert out.columns == ["cell", "x"] and out.count() == 0


def test_parameters_of_engine_and_job_must_agree(spark, folder):
    with pytest.raises(ValueError, match="other parameters"):
        ds.translate_dataset(many(spark), job(), engine(spark, folder, params=JobParams()), folder)


def test_stream_takes_new_files_once(spark, folder, counting):
    e = engine(spark, folder, counting)
    source, log = f"{folder}/in", f"{folder}/log"
    many(spark, 6).where("row_id < 4").write.parquet(source)

    def run(log=log):
        schema = many(spark, 0).schema
        translate_stream(spark, source, schema, job(), e, folder, log).awaitTermination()
        return spark.read.parquet(ds.output_path(folder, job())).count()

    assert run() == 4
    assert run() == 4
    many(spark, 6).where("row_id >= 4").write.mode("append").parquet(source)
    assert run() == 6
    # A lost offset log makes every file new again; rows that are there stay alone.
    assert run(f"{folder}/log2") == 6
    assert counting.calls.value == 6


# ---------------------------------------------------------------- chat backend

ASK = Request("hi", [{"role": "user", "content": "hi"}], "en", "tr", "m", 256)


class Reply(io.BytesIO):
    pass


def test_chat_request(monkeypatch):
    sent = {}

    def urlopen(call, timeout):
        sent.update(url=call.full_url, body=json.loads(call.data), timeout=timeout)
        return Reply(json.dumps({"choices": [{"message": {"content": "selam"}}]}).encode())

    monkeypatch.setattr(backends.urllib.request, "urlopen", urlopen)
    assert ChatBackend("http://host/v1/").complete(ASK) == "selam"
    assert sent["url"] == "http://host/v1/chat/completions"
    assert sent["body"] == {
        "model": "m",
        "messages": ASK.messages,
        "temperature": 0.0,
        "max_tokens": 256,
        "chat_template_kwargs": {"enable_thinking": False},
    }


@pytest.mark.parametrize(
    ("error", "kind"),
    [
        (urllib.error.HTTPError("u", 400, "bad", {}, Reply(b"x")), FatalBackendError),
        (urllib.error.HTTPError("u", 500, "x", {}, Reply(b"Failed to load model")), FatalBackendError),
        (urllib.error.HTTPError("u", 404, "x", {}, Reply(b"invalid_request_error")), FatalBackendError),
        (urllib.error.HTTPError("u", 503, "busy 400", {}, Reply(b"busy")), BackendError),
        (urllib.error.URLError("refused"), BackendError),
        (TimeoutError(), BackendError),
    ],
)
def test_chat_errors(monkeypatch, error, kind):
    def urlopen(call, timeout):
        raise error

    monkeypatch.setattr(backends.urllib.request, "urlopen", urlopen)
    with pytest.raises(kind):
        ChatBackend("http://host").complete(ASK)


@pytest.mark.parametrize("answer", [b"no json", b'{"choices": []}', b"[]"])
def test_odd_answers_are_soft_errors(monkeypatch, answer):
    monkeypatch.setattr(backends.urllib.request, "urlopen", lambda call, timeout: Reply(answer))
    with pytest.raises(BackendError):
        ChatBackend("http://host").complete(ASK)


def test_texts_are_not_sorted_to_find_repeats(spark):
    chunks = spark.createDataFrame([("k", "text"), ("k", "text")], "key string, chunk string")
    found = inference.dedupe_chunks(chunks)
    assert found.count() == 1
    assert "SortAggregate" not in found._jdf.queryExecution().executedPlan().toString()


def test_pairs_do_not_parse_the_table_again(spark, folder):
    df = many(spark).withColumn("cell", F.lit('{"text": "hello there"}'))
    pairs = tr.translation_pairs(df, ["cell"], engine(spark, folder))
    assert pairs.count() == 20
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "Range" not in plan and "Python" not in plan


def test_small_commits_run_side_by_side_and_filters_are_made_once(spark, folder, counting, monkeypatch):
    made = []
    monkeypatch.setattr(inference.filters, "add", lambda *a: made.append(a))
    e = engine(spark, folder, counting, commit_chunks=20, max_requests=3)
    e = replace(e, memory=inference.TranslationMemory(spark, f"{folder}/memory", min_files=1))
    df = e.work.write(spark.range(400).selectExpr("id as row_id", "concat('row ', id) as cell"), "in")
    seen = []
    out = tr.translate_rows(df, ["cell"], replace(e, on_commit=lambda *a: seen.append(a)))
    assert by_id(out) == {i: f"[tr] row {i}" for i in range(400)}
    assert seen == [(i, 20) for i in range(1, 21)] and counting.calls.value == 400
    assert len(made) == 1
    side, tasks = e.side_by_side(20, 20)
    assert (side, tasks) == (3, 1) and side * tasks * e.calls <= 3


def test_a_task_holds_few_texts_at_a_time(spark):
    texts = ["x" * 10] * 2500 + [None] + ["y" * (3 << 20), "z"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["i", "chunk"])
    parts = list(inference._parts(batch, 1))
    assert [i for p in parts for i in p.column(0).to_pylist()] == list(range(len(texts)))
    assert [len(p) for p in parts] == [1000, 1000, 501, 1, 1]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, chunk string").coalesce(1)
    done = inference.translate_chunks(df, StubBackend(), QUICK).collect()
    assert [r.tgt for r in sorted(done)] == [t and f"[tr] {t}" for t in texts]


def shuffles(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_new_chunks_move_once(spark, folder):
    e = engine(spark, folder)
    df = e.work.write(spark.range(40).selectExpr("concat('row ', id % 30) as chunk"), "in")
    df = df.withColumn("key", inference.chunk_key("chunk", QUICK))
    todo = e.memory.missing(df, QUICK, parts=5)
    assert shuffles(todo) == 1 and todo.rdd.getNumPartitions() == 5
    assert sorted(r.chunk for r in todo.collect()) == sorted(f"row {i}" for i in range(30))
    half = df.where(F.length("chunk") == 5)
    e.memory.append(inference.translate_chunks(e.memory.missing(half, QUICK, parts=2), StubBackend(), QUICK), QUICK)
    place = {"slice": F.pmod(F.xxhash64("key"), F.lit(3))}
    left = e.memory.missing(df, QUICK, parts=3, place=place)
    assert sorted(r.chunk for r in left.collect()) == [f"row {i}" for i in range(10, 30)]


@pytest.mark.parametrize("most", [0, 1, 100])
def test_cells_that_are_translated_are_not_moved_along(spark, folder, most):
    faulty = FaultyBackend(soft="sentence number 7.")
    e = engine(spark, folder, faulty, broadcast_keys=most)
    out = tr.translate_rows(cells(spark), ["cell"], e)
    plain = by_id(tr.translate_rows(cells(spark), ["cell"], engine(spark, f"{folder}/b")))
    got = by_id(out)
    assert got[0] == "[tr] plain" and got[2] is None and got[3] == "   " and got[4] == LONG
    assert json.loads(got[1])[1]["content"] == LONG and got[5] == plain[5]


def test_rows_that_are_not_done_are_found_by_ids(spark, folder, monkeypatch):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c"), (2, "d")], "id long, x string")
    for done in ([], [9], [2], [None, 2], [1, 2, 2, None]):
        out = spark.createDataFrame([(d,) for d in done], "id long")
        same = sorted(r.x for r in jobs.remaining(df, out, "id").collect())
        for most in (0, 100):
            monkeypatch.setattr(jobs, "BROADCAST_KEYS", most)
            assert sorted(r.x for r in jobs.not_done(df, out, "id").collect()) == same
    assert jobs.not_done(df, out.limit(0), "id") is df


def many_rows(e, rows):
    spark = e.work.spark
    return e.work.write(spark.range(rows).selectExpr("id as row_id", "concat('row ', id) as cell"), "in")


def jobs_of(spark, tag, act):
    """What ``act`` gives back, and how many jobs it started."""
    spark.sparkContext.addJobTag(tag)
    try:
        return act(), len(spark.sparkContext._jsc.sc().statusTracker().getJobIdsForTag(tag))
    finally:
        spark.sparkContext.removeJobTag(tag)


def test_small_commits_share_jobs(spark, folder, counting, monkeypatch):
    monkeypatch.setattr(tr, "LOT_SECONDS", 60.0)
    odd = f"{folder}/a b%20é"
    e = engine(spark, odd, counting, commit_chunks=10, max_requests=2)
    seen = []
    df, run = many_rows(e, 600), replace(e, on_commit=lambda *a: seen.append(a))
    out, made = jobs_of(spark, "small", lambda: tr.translate_rows(df, ["cell"], run))
    assert by_id(out) == {i: f"[tr] row {i}" for i in range(600)}
    assert seen == [(i, 60) for i in range(1, 61)] and counting.calls.value == 600
    assert made < 45
    sizes = e.memory.rows().groupBy(F.col("_metadata.file_name")).count().collect()
    assert [r["count"] for r in sizes] == [10] * 60
    assert not os.listdir(f"{odd}/memory/{inference.STAGED}")
    assert not [n for n in os.listdir(e.work.root) if n.startswith("todo")]


def no_store(uri):
    raise ValueError(f"unknown kind of store in {uri}")


def test_small_commits_where_tasks_cannot_write(spark, folder, counting, monkeypatch):
    monkeypatch.setattr(inference, "task_folder", no_store)
    e = engine(spark, folder, counting, commit_chunks=10, max_requests=3)
    out = tr.translate_rows(many_rows(e, 120), ["cell"], e)
    assert by_id(out) == {i: f"[tr] row {i}" for i in range(120)}
    assert counting.calls.value == 120


def stored_files(e, files, rows=5):
    """Chunks in so many files, in an order that is the same in each."""
    df = e.work.spark.range(files * rows).selectExpr("cast(id as string) key", "concat('t', id, '.') chunk")
    return e.work.write(df.coalesce(1).sortWithinPartitions(F.col("key").cast("int")), "todo", rows)


def test_commits_of_a_task_stay_when_it_fails(spark, folder, counting):
    e = engine(spark, folder)
    todo, staged = stored_files(e, 4), f"{e.memory.path}/{inference.STAGED}/a"
    assert inference.open_to_tasks(spark, staged)
    with pytest.raises(Exception, match="Failed to load model"):
        e.memory.append_parts(todo, FaultyBackend(fatal="t3."), QUICK, staged, 1)
    keys = {int(r["key"]) for r in e.memory.rows().collect()}  # of larger files, which come first
    assert keys >= set(range(10, 20)) and not keys & set(range(5)) and len(keys) % 5 == 0
    assert e.memory.append_parts(todo, counting, QUICK, staged, 1, 3) == 4
    assert counting.calls.value == 20 - len(keys)
    found = e.memory.rows().orderBy(F.col("key").cast("int")).collect()
    assert [(r["key"], r["src"], r["tgt"]) for r in found] == [
        (str(i), f"t{i}.", f"[tr] t{i}.") for i in range(20)
    ]
    same = {(r["status"], r["attempts"], r["reason"], r["prompt_hash"], r["model"], r["target_lang"]) for r in found}
    assert same == {("ok", 1, None, QUICK.prompt_hash, QUICK.model, QUICK.target_lang)}


def test_a_task_ends_behind_a_commit_when_it_is_to_stop(spark, folder, counting):
    e = engine(spark, folder)
    todo, staged = stored_files(e, 4), f"{e.memory.path}/{inference.STAGED}/a"
    fs = tr.FileSystem(spark, staged)
    fs.write_text(f"{staged}/{inference.STOP}", "")
    assert e.memory.append_parts(todo, counting, QUICK, staged, 1) == 1
    assert e.memory.rows().count() == counting.calls.value == 5


def test_lots_grow_as_long_as_they_are_short_and_end_when_told(spark, folder, monkeypatch):
    monkeypatch.setattr(tr, "LOT_SECONDS", 0.5)
    lots, halted, asked = [], threading.Event(), []

    def commit(lot):
        lots.append(len(lot))
        made = 0
        while made < len(lot) and not (made and halted.is_set()):
            time.sleep(0.02 if len(lot) < 16 else 0.5)
            made += 1
        return made

    def stop():
        asked.append(1)
        return len(lots) > 4 and len(asked) > sum(lots)

    e = engine(spark, folder, should_stop=stop)
    with pytest.raises(tr.Stopped, match="stopped after 1[67] of 400 commits"):
        tr._commit_all(list(range(400)), commit, 1, e, 1, halted.set)
    assert lots == [1, 2, 4, 8, 16]
    assert halted.is_set()


def test_a_stopped_job_has_the_commits_it_began(spark, folder, counting):
    e = engine(spark, folder, counting, commit_chunks=5, max_requests=2)
    asked = []

    def stop():
        asked.append(1)
        return len(asked) > 2

    df = many_rows(e, 100)
    ds.translate_dataset(df, job(), e, folder, check_backend=False, should_stop=stop)
    assert counting.calls.value == e.memory.rows().count() == 5
    ds.translate_dataset(df, job(), e, folder, check_backend=False)
    assert stored(spark, folder) == {i: f"[tr] row {i}" for i in range(100)}
    assert counting.calls.value == 100
