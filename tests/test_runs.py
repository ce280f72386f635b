"""Runs that are logged, watched, stopped and committed once; memories of many files."""

from __future__ import annotations

import threading
import time

import pytest
from pyspark.sql import functions as F

from glossa.backends import BackendError, FatalBackendError, FaultyBackend, StubBackend, why_empty
from glossa.operators import filters, inference, profile, sketches
from glossa.plans import dataset as ds, translate as tr
from glossa.plans.control import Control, finished
from glossa.plans.jobs import remaining
from glossa.plans.runs import commits, last_runs, reason, run_log
from glossa.session import FileSystem, WorkFolder
from glossa.settings import JobParams
from glossa.streaming import incremental as inc
from registry import queries
from registry.queries import SlowBackend

PARAMS = JobParams(retry_wait=0.0)
JOB = ds.Job("d", "train", ("cell",), PARAMS)


def engine(spark, folder, backend=None, **more):
    work = WorkFolder(spark, folder)
    memory = inference.TranslationMemory(spark, f"{folder}/memory")
    return tr.Engine(backend or StubBackend(), PARAMS, memory, work, **more)


def cells(spark, folder, n=40, name="in"):
    path = f"{folder}/{name}"
    spark.range(n).select("id", F.concat(F.lit("text "), "id").alias("cell")).write.parquet(path)
    return spark.read.parquet(path)


def translated(spark, folder, job=JOB):
    return sorted(tuple(r) for r in ds.read_output(spark, f"{folder}/out", job, "none").collect())


def wanted(n=40):
    return sorted((i, f"[tr] text {i}") for i in range(n))


def run(df, folder, e, **more):
    return ds.translate_dataset(df, JOB, e, f"{folder}/out", "id", **more)


# ---------------------------------------------------------------- repeated ids

ODD = [
    (1, "one", "a"), (1, "two", "b"), (1, "two", "b"), (None, "x", "c"), (None, "x", "c"),
    (None, "y", "d"), (None, None, "e"), (2, " ", "f"), (3, '{"content":"z"}', "g"),
]


def odd(spark, folder):
    df = spark.createDataFrame(ODD, "id long, cell string, _found_0 string")
    df = df.withColumns({"_KEY": F.lit(1), "_row": F.lit(2), "_found": F.lit(3)})
    df.repartition(3).write.parquet(f"{folder}/odd")
    return spark.read.parquet(f"{folder}/odd")


def by_hand(cell):
    if cell is None or not cell.strip():
        return cell
    return '{\n  "content": "[tr] z"\n}' if cell.startswith("{") else f"[tr] {cell}"


def test_ids_may_repeat_or_be_null(spark, folder):
    df = odd(spark, folder)
    made = tr.translate_rows(df, ["cell"], engine(spark, folder), "id")
    assert made.columns == [*df.columns, tr.FAILED]
    got = sorted(((r.id, r.cell, r["_found_0"]) for r in made.collect()), key=str)
    assert got == sorted(((i, by_hand(c), x) for i, c, x in ODD), key=str)
    plain = tr.translate_plain(df, "cell", engine(spark, folder), "id").collect()
    assert sorted(((r.id, r.source) for r in plain), key=str) == sorted(((i, c) for i, c, _ in ODD), key=str)
    assert all(r.translation in (r.source, f"[tr] {r.source}") for r in plain)
    pairs = tr.translation_pairs(df, ["cell"], engine(spark, folder), "id").collect()
    want = [(i, "z" if c[0] == "{" else c) for i, c, _ in ODD if c and c.strip()]
    assert sorted(((r.id, r.source) for r in pairs), key=str) == sorted(want, key=str)
    assert all(r.target == f"[tr] {r.source}" for r in pairs)


def test_failures_of_equal_rows_are_counted_once_each(spark, folder):
    bad = engine(spark, folder, FaultyBackend(soft="two"))
    made = tr.translate_rows(odd(spark, folder), ["cell"], bad, "id").collect()
    assert sorted(r.failed_chunks for r in made if r.cell == "two") == [1, 1]
    assert sum(r.failed_chunks for r in made) == 2


@pytest.mark.parametrize("batch_rows", [None, 2, 100])
def test_dataset_with_repeated_ids_goes_on_and_retries(spark, folder, batch_rows):
    df = odd(spark, folder)
    e = engine(spark, folder, FaultyBackend(soft="two"))
    run(df, folder, e, batch_rows=batch_rows, max_batches=1)
    run(df, folder, e, batch_rows=batch_rows)
    path = ds.output_path(f"{folder}/out", JOB)
    assert spark.read.parquet(path).count() == len(ODD)
    good = engine(spark, folder)
    run(df, folder, good, retry_failed=True)
    run(df, folder, good, start_row=2)
    out = spark.read.parquet(path).collect()
    got = sorted(((r.id, r.cell, r["_found_0"]) for r in out), key=str)
    assert got == sorted(((i, by_hand(c), x) for i, c, x in ODD), key=str)


def test_remaining_knows_rows_without_an_id(spark):
    rows = spark.createDataFrame([(1, "a"), (None, "b"), (2, "c")], "row_id long, _done string")
    done = spark.createDataFrame([(None,), (2,)], "row_id long")
    assert [tuple(r) for r in remaining(rows, done).collect()] == [(1, "a")]


# ------------------------------------------------------------- runs and states


def test_a_job_that_broke_down_is_found_with_its_reason(spark, folder):
    df = cells(spark, folder)
    with pytest.raises(Exception):
        run(df, folder, engine(spark, folder, FaultyBackend(fatal="text 7")))
    (state,) = ds.listed_jobs(spark, f"{folder}/out").collect()
    assert (state["status"], state["message"]) == ("error", "400: Failed to load model")
    with pytest.raises(FatalBackendError):
        run(df, folder, engine(spark, folder, FaultyBackend(soft="Hello")))
    (state,) = ds.listed_jobs(spark, f"{folder}/out").collect()
    assert state["status"] == "error" and "gave no translation" in state["message"]
    run(df, folder, engine(spark, folder), batch_rows=15, max_batches=1)
    (state,) = ds.listed_jobs(spark, f"{folder}/out").collect()
    assert (state["status"], state["message"], state["completed_rows"]) == ("running", None, 15)
    run(df, folder, engine(spark, folder), batch_rows=15)
    (state,) = ds.listed_jobs(spark, f"{folder}/out").collect()
    assert (state["status"], state["last_kind"]) == ("completed", "finished")
    kinds = [r.kind for r in run_log(spark, f"{folder}/out").orderBy("at", "step").collect()]
    assert kinds == ["started", "error"] * 2 + ["started", "committed", "stopped"] + [
        "started", "committed", "committed", "finished",
    ]
    assert sum(r.rows for r in commits(spark, f"{folder}/out", JOB.key).collect()) == 40
    assert translated(spark, folder) == wanted()
    ds.restart(spark, f"{folder}/out", JOB)
    assert run_log(spark, f"{folder}/out").count() == 0 == last_runs(spark, folder).count()


def test_reasons_are_short_and_those_of_the_backend():
    assert reason(RuntimeError("")) == "RuntimeError"
    assert reason(RuntimeError("a\nb")) == "a"
    text = "Job aborted\n  File x\nglossa.backends.FatalBackendError: 400: no model\nat java"
    assert reason(RuntimeError(text)) == "400: no model"
    assert len(reason(RuntimeError("x" * 9_000))) == 500


def test_failures_tell_why(spark, folder):
    e = engine(spark, folder, FaultyBackend(soft="text 1", empty="text 2"))
    run(cells(spark, folder, 4), folder, e)
    found = {r.src: r.reason for r in e.memory.failures(PARAMS).collect()}
    assert found == {"text 1": "connection lost", "text 2": inference.EMPTY}
    usage = {"completion_tokens": 9, "completion_tokens_details": {"reasoning_tokens": 9}}
    assert why_empty({"finish_reason": "length"}, usage).startswith(
        "empty answer (ended by length; 9 tokens, 9 of them for reasoning)"
    )
    assert why_empty({}, None) == "empty answer (ended by None)"
    assert issubclass(BackendError, RuntimeError)


# ------------------------------------------------------------ stop and progress


def test_stopped_within_a_commit_and_finished_later(spark, folder):
    df = cells(spark, folder, 400)
    handle, seen = Control(spark), []

    def watch(done, total):
        seen.append((done, total))
        if total:
            handle.stop()

    before = time.perf_counter()
    run(df, folder, engine(spark, folder, SlowBackend(0.05)), control=handle, on_tasks=watch)
    assert handle.asked() and time.perf_counter() - before < 15
    assert all(0 <= done <= total for done, total in seen)
    kinds = [r.kind for r in run_log(spark, f"{folder}/out").collect()]
    assert sorted(kinds) == ["started", "stopped"]
    run(df, folder, engine(spark, folder))
    assert translated(spark, folder) == wanted(400)
    run(df, folder, engine(spark, folder, SlowBackend(0.05)), control=handle)  # stopped before it begins
    assert not list(spark.sparkContext.getJobTags())


def test_an_error_after_a_stop_is_no_error_but_any_other_is(spark, folder):
    df = cells(spark, folder)
    with pytest.raises(Exception):
        run(df, folder, engine(spark, folder, FaultyBackend(fatal="text 7")), control=Control(spark))


def test_stream_is_stopped_within_a_batch_and_taken_up(spark, folder):
    df = cells(spark, folder, 400)
    handle = Control(spark)
    e = engine(spark, folder, SlowBackend(0.05))
    query = inc.translate_stream(
        spark, f"{folder}/in", df.schema, JOB, e, f"{folder}/out", f"{folder}/log", "id", control=handle
    )
    timer = threading.Timer(4, handle.stop)
    timer.start()
    assert finished(query, handle) is False
    timer.join()
    query = inc.translate_stream(
        spark, f"{folder}/in", df.schema, JOB, engine(spark, folder), f"{folder}/out", f"{folder}/log", "id"
    )
    assert finished(query, Control(spark)) is True
    assert translated(spark, folder) == wanted(400)


def test_counts_of_micro_batches(spark, folder):
    for i in range(3):
        part = spark.range(10 * i, 10 * i + 10).select("id", F.concat(F.lit("text "), "id").alias("cell"))
        part.coalesce(1).write.mode("append").parquet(f"{folder}/in")
    schema = spark.read.parquet(f"{folder}/in").schema
    told, progress = [], inc.StreamProgress()
    spark.streams.addListener(progress)
    try:
        query = inc.translate_stream(
            spark, f"{folder}/in", schema, JOB, engine(spark, folder, FaultyBackend(soft="text 25")),
            f"{folder}/out", f"{folder}/log", "id", max_files=1,
            on_commit=lambda n, counts: told.append((n, counts["read"], counts["rows"], counts[tr.FAILED])),
        )
        progress.query_id = str(query.id)
        query.awaitTermination()
        assert progress.ended.wait(60)
    finally:
        spark.streams.removeListener(progress)
    assert told == [(0, 10, 10, 0), (1, 10, 10, 0), (2, 10, 10, 1)]
    assert sorted(progress.milliseconds) == [0, 1, 2]
    found = commits(spark, f"{folder}/out", JOB.key).orderBy("batch").collect()
    assert [(r.batch, r.rows_read, r.rows, r.failed_chunks) for r in found] == told


# ------------------------------------------------------- batches committed once


def test_the_same_batch_twice_does_not_call_the_backend(spark, folder):
    df = cells(spark, folder)
    out = f"{folder}/out"
    assert inc.commit_batch(df, "s-0", JOB, engine(spark, folder), out, "id")["rows"] == 40
    broken = tr.Engine(
        FaultyBackend(fatal=""), PARAMS, inference.TranslationMemory(spark, f"{folder}/none"),
        WorkFolder(spark, folder),
    )
    assert inc.commit_batch(df, "s-0", JOB, broken, out, "id") is None
    again = df.withColumn("id", F.col("id") + 30)
    made = inc.commit_batch(again, "s-1", JOB, engine(spark, folder), out, "id")
    assert (made["read"], made["rows"]) == (40, 30)  # ten ids were there already
    assert len(translated(spark, folder)) == 70
    assert inc.commit_batch(df.limit(0), "s-2", JOB, broken, out, "id")["rows"] == 0


def test_a_batch_that_was_lost_half_way_goes_on(spark, folder):
    df = cells(spark, folder).repartition(4, "id")
    out, path = f"{folder}/out", ds.output_path(f"{folder}/out", JOB)
    fs = FileSystem(spark, path)
    staged = f"{ds.job_folder(out, ds.STAGED, JOB)}/s-0"
    inc._stage(df, ["cell"], engine(spark, folder), path, staged, "id", JOB)
    names = [n for n in fs.files(staged) if n.startswith("part-")]
    assert len(names) > 1
    fs._fs.mkdirs(fs._path(path))
    fs.rename(f"{staged}/{names[0]}", f"{path}/batch-s-0-{names[0]}")  # lost here
    broken = tr.Engine(
        FaultyBackend(fatal=""), PARAMS, inference.TranslationMemory(spark, f"{folder}/none"),
        WorkFolder(spark, folder),
    )
    inc.commit_batch(df, "s-0", JOB, broken, out, "id")
    spark.catalog.refreshByPath(path)
    assert translated(spark, folder) == wanted()
    assert not fs.exists(staged)


# ------------------------------------------------------------ memory and sketches


def test_few_keys_open_few_files(spark, folder):
    memory = inference.TranslationMemory(spark, f"{folder}/memory", min_files=5)
    df = spark.range(1_000).select((F.col("id") % 20).alias("b"), F.concat(F.lit("t "), "id").alias("chunk"))
    keyed = df.withColumn("key", inference.chunk_key("chunk", PARAMS))
    for b in range(20):
        part = keyed.where(F.col("b") == b).drop("b").coalesce(1)
        memory.append(inference.translate_chunks(part, StubBackend(), PARAMS, reasons=True), PARAMS)
    path = F.col("_metadata.file_path")
    one = keyed.where("b = 7").select("key")
    assert memory.opened(one).select(path).distinct().count() == 1
    assert memory.known(PARAMS, one).count() == 50
    assert memory.opened(None).select(path).distinct().count() == 20
    assert memory.missing(keyed, PARAMS, keyed.select("key")).count() == 0
    new = keyed.select(F.reverse("key").alias("key")).limit(5)
    assert memory.known(PARAMS, new).count() == 0
    # Files that have lost their filters are opened.
    FileSystem(spark, folder).delete(f"{folder}/memory/{filters.FOLDER}")
    assert memory.known(PARAMS, one).count() == 50
    memory.add_filters()
    assert memory.opened(one).select(path).distinct().count() == 1


def test_filters_hold_what_was_put_in():
    import hashlib

    keys = [hashlib.sha256(str(i).encode()).hexdigest()[:32] for i in range(40_000)]
    bits = filters.filter_of(filters.words_of(keys[:10_000]))
    assert all(filters.may_hold(bits, 10_000, filters.words_of([k])) for k in keys[:200])
    others = filters.words_of(keys[10_000:])
    assert sum(filters.may_hold(bits, 10_000, others[i : i + 1]) for i in range(2_000)) == 0
    assert not filters.may_hold(bits, 10_000, others[:0])
    assert filters.may_hold(filters.filter_of(filters.words_of(keys[:1])), 1, filters.words_of(keys[:1]))


def test_sketches_merge_to_those_of_the_whole(spark, folder):
    df = spark.range(5_000).select(
        "id", (F.col("id") % 7).cast("string").alias("few"), F.lit(None).cast("double").alias("none"),
    )
    for b in range(5):
        for _ in range(2):  # a batch that is stored again counts once
            sketches.store_sketches(sketches.column_sketches(df.where(F.col("id") % 5 == b)), folder, str(b))
    grown = sketches.sketched_stats(sketches.stored_sketches(spark, folder))
    once = sketches.sketched_stats(sketches.column_sketches(df))
    assert sorted(map(tuple, grown.collect())) == sorted(map(tuple, once.collect()))
    found = {r["column"]: (r["non_null"], r["distinct_values"]) for r in grown.collect()}
    assert found["few"] == (5_000, 7) and found["none"] == (0, 0) and found["id"][0] == 5_000
    assert abs(found["id"][1] - 5_000) <= 4 * sketches.ERROR * 5_000
    assert sketches.stored_sketches(spark, f"{folder}/nothing").count() == 0
    card = profile.dataset_card(df, "d", "src", row_id="id", stats=grown)
    assert "| few | string | 5000 | about 7 |" in card


def test_a_job_keeps_sketches_also_after_rows_were_replaced(spark, folder):
    df = cells(spark, folder)
    bad = engine(spark, folder, FaultyBackend(soft="text 7"))
    run(df, folder, bad, batch_rows=15, sketch=True)
    stats = {r["column"]: r for r in ds.output_stats(spark, f"{folder}/out", JOB).collect()}
    assert stats["cell"]["non_null"] == 40 and stats["id"]["distinct_values"] == 40
    run(df, folder, engine(spark, folder), retry_failed=True, sketch=True)
    stats = {r["column"]: r for r in ds.output_stats(spark, f"{folder}/out", JOB).collect()}
    assert stats["cell"]["non_null"] == 40 == stats["cell"]["distinct_values"]
    assert translated(spark, folder) == wanted()


def test_parts_of_a_streamed_table_have_files_of_bounded_size(spark, folder):
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.sha2(F.col("id").cast("string"), 256).alias("text"))
    docs.repartition(2).write.parquet(f"{folder}/documents.parquet")
    for size, files in ((1 << 30, 1), (2_000, None)):
        e = engine(spark, f"{folder}/{size}")
        source, df, many = queries._streamed(spark, folder, e, size)
        assert many == files or (files is None and many > 2)
        found = spark.read.parquet(source).select("*", F.col("_metadata.file_path").alias("file"))
        assert sorted(found.drop("file").collect()) == sorted(df.collect())
        of = found.groupBy("file").agg(F.collect_set(F.col("doc_id") % 4).alias("rests")).collect()
        assert len(of) == 4 * many and all(len(r["rests"]) == 1 for r in of)
