"""What happened to jobs, as a log that only grows.

Every run of a job adds its own records below the output folder: started, committed,
finished, stopped or error. The state of a job is its newest record, so two drivers, or one
that died, cannot damage what others wrote.
"""

from __future__ import annotations

import json
import re
import uuid
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession, functions as F

from glossa.session import FileSystem

RUNS = "_runs"
SCHEMA = (
    "run string, step long, kind string, message string, batch long, rows long, "
    "failed_chunks long, rows_read long, at timestamp, job string"
)
MESSAGE_CHARS = 500

# The line of a task's error that says what the backend said.
_BACKEND_SAID = re.compile(r"\w*BackendError: *(.+)")


def reason(error: BaseException) -> str:
    """What a backend said last, or else the error's first line."""
    text = str(error)
    said = _BACKEND_SAID.findall(text)
    line = said[-1] if said else next((x for x in text.splitlines() if x.strip()), "")
    return (line.strip() or type(error).__name__)[:MESSAGE_CHARS]


class Run:
    """The records of one run of a job."""

    def __init__(self, spark: SparkSession, root: str, job: str):
        self.spark = spark
        self.path = f"{root.rstrip('/')}/{RUNS}/job={job}"
        self.name = uuid.uuid4().hex
        self.step = 0

    def add(
        self,
        kind: str,
        message: str | None = None,
        batch: int | None = None,
        rows: int | None = None,
        failed: int | None = None,
        read: int | None = None,
    ) -> None:
        record = {
            "run": self.name, "step": self.step, "kind": kind, "message": message, "batch": batch,
            "rows": rows, "failed_chunks": failed, "rows_read": read,
            "at": datetime.now(timezone.utc).isoformat(),
        }
        file = f"{self.path}/{self.name}-{self.step:06}.json"
        FileSystem(self.spark, file).write_text(file, json.dumps(record) + "\n")
        self.step += 1


def run_log(spark: SparkSession, root: str) -> DataFrame:
    """All records of all jobs below ``root``."""
    path = f"{root.rstrip('/')}/{RUNS}"
    if not FileSystem(spark, path).folders(path):
        return spark.createDataFrame([], SCHEMA)
    # A record that is being written just now cannot be read yet.
    return spark.read.schema(SCHEMA).json(path).where(F.col("kind").isNotNull())


def last_runs(spark: SparkSession, root: str) -> DataFrame:
    """(job, last_kind, message, last_at): the newest record of each job."""
    newest = F.max_by(F.struct("kind", "message", "at"), F.struct("at", "step"))
    return run_log(spark, root).groupBy("job").agg(newest.alias("r")).select(
        "job", F.col("r.kind").alias("last_kind"), F.col("r.message").alias("message"),
        F.col("r.at").alias("last_at"),
    )


def commits(spark: SparkSession, root: str, job: str) -> DataFrame:
    """(run, batch, rows_read, rows, failed_chunks, at) of every commit of a job."""
    mine = (F.col("job") == job) & (F.col("kind") == "committed")
    return run_log(spark, root).where(mine).select(
        "run", "batch", "rows_read", "rows", "failed_chunks", "at"
    )
