"""Translate a whole dataset in committed batches, and go on where it stopped."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F, types as T

from glossa.functions.text import safe_name_of
from glossa.operators.cells import chosen_columns, replace_columns
from glossa.operators.rows import ROW_ID, rows_from
from glossa.operators.sketches import (
    KINDS, column_sketches, sketch_aggregates, sketch_rows, sketched_stats, store_sketches,
    stored_sketches,
)
from glossa.plans.control import Control, Watcher
from glossa.plans.jobs import job_states, not_done, remaining, with_pending, with_progress
from glossa.plans.runs import RUNS, Run, last_runs, reason
from glossa.plans.translate import FAILED, Engine, Stopped, require_backend, translate_rows
from glossa.session import CODEC, FileSystem, folder_value
from glossa.settings import JobParams

Progress = Callable[[int, int, str], None]


# Beside the output: records of the jobs that were started, marks of committed
# micro-batches, and files of those that are not committed yet.
RECORDS = "_jobs"
COMMITS = "_commits"
STAGED = "_staged"
SKETCHES = "_sketches"
RECORD = (
    "dataset_id string, split string, columns array<string>, source_lang string, "
    "target_lang string, model string, total_rows long"
)


@dataclass(frozen=True)
class Job:
    """Which columns of which split are translated, and how."""

    dataset: str
    split: str
    columns: tuple[str, ...]
    params: JobParams = JobParams()

    @property
    def key(self) -> str:
        """Differs for every choice that changes the output."""
        p = self.params
        parts = (
            self.dataset,
            self.split,
            *self.columns,
            p.scope,
            p.json_mode,
            ",".join(p.translate_keys),
            ",".join(p.skip_keys),
        )
        return hashlib.sha256("\x1e".join(parts).encode()).hexdigest()[:12]


def output_path(root: str, job: Job) -> str:
    """The folder of the job's output, laid out for partition discovery."""
    dataset, split = (folder_value(safe_name_of(n)) for n in (job.dataset, job.split))
    return (
        f"{root.rstrip('/')}/dataset={dataset}/split={split}"
        f"/target_lang={job.params.target_lang}/job={job.key}"
    )


def job_folder(root: str, kind: str, job: Job) -> str:
    return f"{root.rstrip('/')}/{kind}/job={job.key}"


def read_output(spark: SparkSession, root: str, job: Job, row_id: str = ROW_ID) -> DataFrame:
    """The translated table: the original columns, in order."""
    return spark.read.parquet(output_path(root, job)).drop(row_id, FAILED)


def output_stats(spark: SparkSession, root: str, job: Job) -> DataFrame:
    """``column_stats`` of the output of a job that keeps sketches, with its error."""
    return sketched_stats(stored_sketches(spark, job_folder(root, SKETCHES, job)))


def restart(spark: SparkSession, root: str, job: Job) -> None:
    """Forget what the job has done; its input stays."""
    path = output_path(root, job)
    fs = FileSystem(spark, path)
    fs.recover(path)
    fs.delete(path)
    for kind in (RECORDS, RUNS, COMMITS, STAGED, SKETCHES):
        fs.delete(job_folder(root, kind, job))


def stored_output(
    spark: SparkSession, path: str, like: DataFrame, columns: tuple[str, ...]
) -> DataFrame:
    """Rows committed so far; none before the first batch. Translated columns are text."""
    texts = {c: F.col(f"`{c}`").cast("string") for c in columns}
    empty = replace_columns(like.limit(0), texts).withColumn(FAILED, F.lit(0).cast("long"))
    fs = FileSystem(spark, path)
    fs.recover(path)
    return spark.read.schema(empty.schema).parquet(path) if fs.has_data(path) else empty


def _keep_only(spark: SparkSession, path: str, kept: DataFrame) -> None:
    kept.write.mode("overwrite").parquet(f"{path}.new", compression=CODEC)
    FileSystem(spark, path).replace(path, f"{path}.new")
    spark.catalog.refreshByPath(path)


def append_batch(
    todo: DataFrame,
    columns: list[str],
    engine: Engine,
    path: str,
    row_id: str = ROW_ID,
    sketch_to: tuple[str, str] | None = None,
) -> dict:
    """Translate rows and commit them; tells how many rows and failed chunks there were.

    ``sketch_to`` (folder, batch) keeps sketches of what is written, taken on the way.
    """
    run = engine.fresh()
    seen = Observation()
    try:
        rows = translate_rows(todo, columns, run, row_id)
        counts = [F.coalesce(F.sum(FAILED), F.lit(0)).alias(FAILED)]
        kept = rows.drop(FAILED)
        counts += sketch_aggregates(kept) if sketch_to else [F.count(F.lit(1)).alias("rows")]
        rows.observe(seen, *counts).write.mode("append").parquet(path, compression=CODEC)
    finally:
        run.work.drop()
    if sketch_to:
        made = todo.sparkSession.createDataFrame(sketch_rows(kept, seen.get), KINDS)
        store_sketches(made, *sketch_to)
    return seen.get


def translate_dataset(
    df: DataFrame,
    job: Job,
    engine: Engine,
    root: str,
    row_id: str = ROW_ID,
    start_row: int | None = None,
    batch_rows: int | None = None,
    max_batches: int | None = None,
    on_progress: Progress | None = None,
    retry_failed: bool = False,
    check_backend: bool = True,
    should_stop: Callable[[], bool] | None = None,
    control: Control | None = None,
    on_tasks: Watcher | None = None,
    sketch: bool = False,
) -> str:
    """Translate all rows that have no output yet; gives back the output folder.

    ``batch_rows`` rows make a batch, whose output is committed as a whole; with None
    there is one batch. Either way the engine commits what the backend gave it much
    more often, so a batch that is run again makes few calls again. The memory is
    looked through once per batch: make batches large. ``max_batches`` stops after so
    many, ``should_stop`` is asked before each batch and each commit within.

    ``start_row`` replaces the output from that row on, ``retry_failed`` that of rows in
    which a chunk failed. The rows are translated aside, and the output changes when all
    of them are there; a run that stops before goes on when it is called again.

    ``control.stop()`` ends the run from another thread, also within a commit; ``on_tasks``
    is told meanwhile how far the tasks are. How the run began and ended is logged beside
    the output, see ``runs``. With ``sketch`` each batch leaves sketches of its columns, and
    ``output_stats`` counts the output without reading it; all runs of a job should agree.
    """
    spark = df.sparkSession
    if engine.params != job.params:
        raise ValueError("the engine was made for other parameters than the job")
    control = control or Control(spark)
    run = Run(spark, root, job.key)

    def stop() -> bool:
        asked = should_stop or engine.should_stop
        return control.asked() or bool(asked and asked())

    run.add("started")
    try:
        with control.tagged(), control.watched(on_tasks):
            path, ended = _translate(
                df, job, replace(engine, should_stop=stop), root, row_id, start_row, batch_rows,
                max_batches, on_progress, retry_failed, check_backend, run, sketch,
            )
    except Exception as e:
        if not control.asked():
            run.add("error", reason(e))
            raise
        path, ended = output_path(root, job), "stopped"
    run.add(ended)
    return path


def _translate(
    df: DataFrame, job: Job, engine: Engine, root: str, row_id: str, start_row: int | None,
    batch_rows: int | None, max_batches: int | None, on_progress: Progress | None,
    retry_failed: bool, check_backend: bool, log: Run, sketch: bool,
) -> tuple[str, str]:
    """The output folder, and how the run ended."""
    spark = df.sparkSession
    columns = chosen_columns(df, list(job.columns))
    path = output_path(root, job)
    fs = FileSystem(spark, path)
    fs.recover(path)
    again = fs.has_data(path) and (start_row is not None or retry_failed)
    wanted, target = rows_from(df, start_row, row_id) if start_row else df, path
    if again:
        before = stored_output(spark, path, df, job.columns)
        # A row without an id comes before any other.
        late = F.lit(False) if start_row is None else F.coalesce(F.col(row_id) >= start_row, F.lit(False))
        kept = before.where(~late)
        failed = before.where(F.col(FAILED) > 0).select(row_id).distinct()
        if retry_failed:
            kept = remaining(kept, failed, row_id)  # all rows of an id, or none
        # Rows that are not kept, and rows that had no output yet.
        wanted = not_done(wanted, kept, row_id)
        if start_row and retry_failed:
            early = df.where(F.coalesce(F.col(row_id) < start_row, F.lit(True)))
            again_ids = failed.withColumnRenamed(row_id, "_failed")
            same = F.col(row_id).eqNullSafe(F.col("_failed"))
            wanted = wanted.unionByName(early.join(again_ids, same, "left_semi"))
        target = f"{path}.redo-{'' if start_row is None else start_row}-{int(retry_failed)}"
    done = stored_output(spark, target, df, job.columns)
    batches, finished, total = _batches(wanted, done, row_id, batch_rows)
    if not again:
        _write_record(spark, root, job, total)
    if check_backend:
        require_backend(spark, engine)

    def told(commit: int, commits: int) -> None:
        if on_progress:
            on_progress(finished, total, f"{label}, commit {commit} of {commits}")

    run = replace(engine, on_commit=told)
    for i, (label, todo) in enumerate(batches[:max_batches]):
        if run.should_stop():
            return path, "stopped"
        if on_progress:
            on_progress(finished, total, label)
        try:
            place = (job_folder(root, SKETCHES, job), f"{log.name}-{i}") if sketch and not again else None
            made = append_batch(todo, columns, run, target, row_id, place)
        except Stopped:
            return path, "stopped"
        finished += made["rows"]
        log.add("committed", label, i, made["rows"], made[FAILED])
        if on_progress:
            on_progress(finished, total, f"{label} done")
    if not fs.has_data(target):
        done.write.mode("append").parquet(target)
    whole = max_batches is None or len(batches) <= max_batches
    if again and whole:
        made = stored_output(spark, target, df, job.columns)
        _keep_only(spark, path, kept.unionByName(made))
        fs.delete(target)
        if sketch:  # rows were replaced, which sketches cannot forget
            place = job_folder(root, SKETCHES, job)
            fs.delete(place)
            written = stored_output(spark, path, df, job.columns).drop(FAILED)
            store_sketches(column_sketches(written), place, log.name)
    return path, "finished" if whole else "stopped"


def _batches(
    df: DataFrame, done: DataFrame, row_id: str, batch_rows: int | None
) -> tuple[list[tuple[str, DataFrame]], int, int]:
    """Batches with rows to translate, rows that are done, and all rows.

    Positions without gaps are cut in ranges, which the statistics of a stored table
    answer; other ids are dealt out by a hash, so that there are as many batches as
    the number of rows asks for, whatever the ids are. Batches are compared by the
    number and a checksum of their row ids, so ids are only joined in batches of which
    a part is done.
    """
    number = F.lit(0).cast("long")
    low, dense = 0, False
    if batch_rows:
        ends = df.agg(
            F.min(row_id).alias("low"), F.max(row_id).alias("high"), F.count(row_id).alias("named"),
            F.count(F.lit(1)).alias("n"),
        ).first()
        many = ends["n"]
        if isinstance(df.schema[row_id].dataType, T.IntegralType) and ends["named"] == many > 0:
            low, dense = ends["low"], ends["high"] - ends["low"] + 1 == many
        if dense:
            number = F.expr(f"(`{row_id}` - {low}L) div {batch_rows}L")
        else:
            number = F.pmod(F.xxhash64(row_id), F.lit(max(1, -(-many // batch_rows))).cast("long"))

    def sums(rows: DataFrame, size: str, check: str) -> DataFrame:
        return rows.groupBy(number.alias("batch")).agg(
            F.count(F.lit(1)).alias(size),
            F.sum(F.xxhash64(row_id).cast("decimal(38,0)")).alias(check),
        )

    # One small row per commit the driver may make.
    found = sums(df, "n", "check").join(sums(done, "done", "done_check"), "batch", "left")
    batches, finished = [], 0
    rows = found.orderBy("batch").collect()
    for r in rows:
        mine = number == r["batch"] if batch_rows else F.lit(True)
        if dense:
            start = low + r["batch"] * batch_rows
            mine = (F.col(row_id) >= start) & (F.col(row_id) < start + batch_rows)
        todo = df.where(mine)
        finished += r["done"] or 0
        if (r["n"], r["check"]) == (r["done"], r["done_check"]):
            continue
        if r["done"]:
            todo = not_done(todo, done.where(mine), row_id)
        batches.append((f"batch {r['batch']}", todo))
    return batches, finished, sum(r["n"] for r in rows)


def _write_record(spark: SparkSession, root: str, job: Job, total: int) -> None:
    """What has to be known of a job to find it from the output folder alone."""
    p = job.params
    record = (
        job.dataset, job.split, list(job.columns), p.source_lang, p.target_lang, p.model, total
    )
    row = spark.createDataFrame([record], RECORD).withColumn("started_at", F.current_timestamp())
    row.coalesce(1).write.mode("overwrite").json(job_folder(root, RECORDS, job))


def found_states(spark: SparkSession, root: str) -> DataFrame:
    """The states of all jobs whose output is below ``root``, from what is stored there.

    One scan of the records, one of the runs and one of the output, which reads no data
    columns. ``last_kind`` and ``message`` are those of the newest record of a run.
    """
    at = f"{root.rstrip('/')}/{RECORDS}"
    kinds = f"{RECORD}, started_at timestamp, job string"
    if not FileSystem(spark, at).folders(at):
        records = spark.createDataFrame([], kinds)
    else:
        records = spark.read.schema(kinds).json(at)
    if not [f for f in FileSystem(spark, root).folders(root) if f.startswith("dataset=")]:
        done = spark.createDataFrame([], "job string, completed_rows long, updated_at timestamp")
    else:
        done = (
            spark.read.schema("dataset string, split string, target_lang string, job string")
            .parquet(root)
            .select("job", F.col("_metadata.file_modification_time").alias("saved_at"))
            .groupBy("job")
            .agg(F.count(F.lit(1)).alias("completed_rows"), F.max("saved_at").alias("updated_at"))
        )
    zero = F.lit(0).cast("long")
    known = records.join(done, "job", "left").join(last_runs(spark, root), "job", "left")
    return known.withColumn("completed_rows", F.coalesce("completed_rows", zero))


def listed_jobs(spark: SparkSession, root: str) -> DataFrame:
    """All jobs below ``root`` with their share, status and, after an error, its message."""
    failed = F.coalesce(F.col("last_kind") == "error", F.lit(False))
    states = with_progress(with_pending(found_states(spark, root)), failed)
    told = F.when(F.col("status") == "error", F.col("message"))
    return states.withColumn("message", told)


def job_state(df: DataFrame, job: Job, root: str, row_id: str = ROW_ID) -> DataFrame:
    """The state record of one job."""
    path = output_path(root, job)
    output = stored_output(df.sparkSession, path, df, job.columns)
    stamp = F.lit(None).cast("timestamp")
    if FileSystem(df.sparkSession, path).has_data(path):
        stamp = F.col("_metadata.file_modification_time")
    named = {
        "dataset_id": F.lit(job.dataset),
        "split": F.lit(job.split),
        "target_lang": F.lit(job.params.target_lang),
        "job": F.lit(job.key),
    }
    done = output.select(row_id, stamp.alias("saved_at")).withColumns(named)
    inputs = df.select(row_id).withColumns(named)
    states = job_states(inputs, done, list(named), row_id, F.col("saved_at"))
    return states.withColumn("columns", F.array(*(F.lit(c) for c in job.columns)))


def all_states(jobs: list[tuple[Job, DataFrame]], root: str, row_id: str = ROW_ID) -> DataFrame:
    """The state records of several jobs, each given with its input."""
    states = [job_state(df, job, root, row_id) for job, df in jobs]
    return reduce(DataFrame.unionByName, states)
