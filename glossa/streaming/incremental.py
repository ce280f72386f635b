"""Translate new files of a folder as they come, each row once."""

from __future__ import annotations

import json
import threading
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.listener import StreamingQueryListener

from glossa.operators.rows import ROW_ID
from glossa.plans.control import Control
from glossa.plans.dataset import COMMITS, STAGED, Job, job_folder, output_path, stored_output
from glossa.plans.jobs import not_done
from glossa.plans.runs import Run, reason
from glossa.plans.translate import FAILED, Engine, Stopped, translate_rows
from glossa.session import CODEC, FileSystem


def commit_batch(
    batch: DataFrame,
    number: str,
    job: Job,
    engine: Engine,
    root: str,
    row_id: str = ROW_ID,
) -> dict | None:
    """Translate a micro-batch and commit it once, however often it is given.

    ``number`` tells it from all other batches of the job, also those of other streams.

    The output is written aside and then moved to its place under names that start with
    the number of the batch, and a mark says that all is there. A run that was lost goes
    on with the step it was in: a batch with a mark does nothing, one that is written does
    not call the backend again, and a file that was moved already is not moved twice.
    Rows whose id is in the output of an earlier batch are left out.
    """
    session = batch.sparkSession
    path = output_path(root, job)
    fs = FileSystem(session, path)
    mark, staged = (f"{job_folder(root, kind, job)}/{number}" for kind in (COMMITS, STAGED))
    if fs.exists(mark):
        return None
    counts = None
    if not fs.exists(f"{staged}/_SUCCESS"):
        counts = _stage(batch, list(job.columns), engine, path, staged, row_id, job)
    if fs.exists(staged):
        fs.move_files(staged, path, f"batch-{number}-")
    fs.write_text(mark, "")
    fs.delete(staged)
    return counts or {"read": None, "rows": None, FAILED: None}


def _stage(
    batch: DataFrame, columns: list[str], engine: Engine, path: str, staged: str, row_id: str, job: Job
) -> dict | None:
    ends = batch.agg(
        F.min(row_id).alias("low"), F.max(row_id).alias("high"), F.count(F.lit(1)).alias("n")
    ).first()
    if not ends["n"]:
        return {"read": 0, "rows": 0, FAILED: 0}
    # Only output files that can hold rows of this batch are looked into.
    done = stored_output(batch.sparkSession, path, batch, job.columns).where(
        F.col(row_id).between(ends["low"], ends["high"])
    )
    run = engine.fresh()
    seen = Observation()
    counted = [
        F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(FAILED), F.lit(0)).alias(FAILED)
    ]
    try:
        made = translate_rows(not_done(batch, done, row_id), columns, run, row_id)
        made.observe(seen, *counted).write.mode("overwrite").parquet(staged, compression=CODEC)
    finally:
        run.work.drop()
    return {"read": ends["n"], **seen.get}


class StreamProgress(StreamingQueryListener):
    """Follows one stream as Spark reports it: the time each micro-batch took, and the end.

    The rows of a micro-batch are read several times, and Spark counts them each time, so
    counts are those of the commits.
    """

    def __init__(self, told: Callable[[int, int], None] | None = None):
        self.milliseconds: dict[int, int] = {}
        self.told = told
        self.query_id: str | None = None
        self.ended = threading.Event()

    def _mine(self, event) -> bool:
        return self.query_id is None or str(event.id) == self.query_id

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        found = event.progress
        if self._mine(found) and found.numInputRows:
            took = found.durationMs.get("triggerExecution", 0)
            self.milliseconds[found.batchId] = took
            if self.told:
                self.told(found.batchId, took)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        if self._mine(event):
            self.ended.set()


def translate_stream(
    spark: SparkSession,
    source: str,
    schema,
    job: Job,
    engine: Engine,
    root: str,
    checkpoint: str,
    row_id: str = ROW_ID,
    max_files: int = 1000,
    control: Control | None = None,
    keep_running: str | None = None,
    on_commit: Callable[[int, dict], None] | None = None,
) -> StreamingQuery:
    """Start a query that translates all files not seen yet, then ends.

    A micro-batch may run again after a failure: its number is looked up before the work,
    see ``commit_batch``. Rows that are already in the output are left out, so a row with
    an id is written once; one without an id is new in every file. ``max_files`` bounds a
    micro-batch, and with it what one commit may lose. ``control.stop()`` ends the query
    within a micro-batch too, which the next query of the same checkpoint takes up again.
    With ``keep_running``, as "1 minute", the query looks for files at that interval and
    does not end by itself. ``on_commit`` is told the number of a micro-batch and its counts
    (read, rows, failed_chunks); they are logged as well, see ``runs.commits``.
    """
    handle = control or Control(spark)
    log = Run(spark, root, job.key)
    calls = engine.should_stop

    def stop() -> bool:
        return handle.asked() or bool(calls and calls())

    run = replace(engine, should_stop=stop)

    def commit(batch: DataFrame, number: int) -> None:
        if stop():
            raise Stopped("stopped before a batch")
        # The id of the checkpoint: batches of a new one count from 0 again.
        stream = json.loads(FileSystem(spark, checkpoint).read_text(f"{checkpoint}/metadata"))["id"]
        try:
            with handle.tagged():
                made = commit_batch(batch, f"{stream}-{number:09}", job, run, root, row_id)
        except Exception as e:
            log.add("stopped" if stop() else "error", reason(e), number)
            raise
        if made:
            log.add("committed", None, number, made["rows"], made[FAILED], made["read"])
            if on_commit:
                on_commit(number, made)

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(source)
    writer = stream.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint)
    when = {"processingTime": keep_running} if keep_running else {"availableNow": True}
    log.add("started")
    return handle.attach(writer.trigger(**when).start())
