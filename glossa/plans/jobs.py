"""The state of jobs, derived from their input and output rows.

There is no state file that could disagree with the data: a row is done when it
is in the output.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from glossa.operators.cells import spare
from glossa.operators.inference import BROADCAST_KEYS
from glossa.operators.rows import ROW_ID

STATE_SCHEMA = (
    "dataset_id string, split string, columns array<string>, total_rows long, "
    "completed_rows long, last_saved_row long, timestamp string"
)
CORRUPT = "_corrupt"


def job_states(
    inputs: DataFrame,
    outputs: DataFrame,
    by: list[str],
    row_id: str = ROW_ID,
    saved_at: Column | None = None,
) -> DataFrame:
    """One state per job; ``by`` names the columns that tell jobs apart.

    A job without output has 0 completed rows, last row -1 and no time.
    """
    totals = inputs.groupBy(*by).agg(F.count(F.lit(1)).alias("total_rows"))
    when = F.lit(None).cast("timestamp") if saved_at is None else saved_at
    done = outputs.groupBy(*by).agg(
        F.count(F.lit(1)).alias("completed_rows"),
        F.max(row_id).alias("last_saved_row"),
        F.max(when).alias("updated_at"),
    )
    return totals.join(done, by, "left").select(
        *by,
        "total_rows",
        F.coalesce("completed_rows", F.lit(0).cast("long")).alias("completed_rows"),
        F.coalesce("last_saved_row", F.lit(-1).cast("long")).alias("last_saved_row"),
        "updated_at",
    )


def with_pending(states: DataFrame) -> DataFrame:
    """Add whether a job was begun and not finished."""
    done, total = F.col("completed_rows"), F.col("total_rows")
    return states.withColumn("has_pending", (done > 0) & (done < total))


def pending_jobs(states: DataFrame) -> DataFrame:
    """All unfinished jobs, also those not begun."""
    return states.where(F.col("completed_rows") < F.col("total_rows"))


def latest_pending(
    states: DataFrame, by: list[str], saved: DataFrame | None = None
) -> DataFrame:
    """The unfinished job saved last, if its data (a row in ``saved``) is still there."""
    latest = pending_jobs(states).orderBy(F.col("updated_at").desc_nulls_last(), *by).limit(1)
    return latest if saved is None else latest.join(saved.select(*by).distinct(), by, "left_semi")


def with_progress(states: DataFrame, error: Column | None = None) -> DataFrame:
    """Add the share that is done, 0 for an empty job, and a status.

    ``error`` says of a job that is not complete that its last run ended with an error.
    """
    done, total = F.col("completed_rows"), F.col("total_rows")
    return states.withColumns(
        {
            "progress": F.when(total > 0, done / total).otherwise(F.lit(0.0)),
            "status": F.when(done >= total, "completed")
            .when(F.lit(False) if error is None else error, "error")
            .when(done > 0, "running")
            .otherwise("idle"),
        }
    )


def job_summary(
    states: DataFrame, dataset: Column, split: Column, columns: list[str], source: str, target: str
) -> DataFrame:
    """The state with a text for people: rows, columns, languages, what is left."""
    if not columns:
        raise ValueError("no columns selected")
    lines = F.concat_ws(
        "\n",
        F.format_string("Dataset: %s | Split: %s | Rows: %d", dataset, split, "total_rows"),
        F.lit(f"Columns: {', '.join(columns)}"),
        F.lit(f"Language: {source} -> {target}"),
        F.when(
            F.col("has_pending"),
            F.format_string(
                "Pending job: %d/%d rows done", F.col("completed_rows"), F.col("total_rows")
            ),
        ),
    )
    return with_pending(states).withColumn("summary", lines)


def remaining(inputs: DataFrame, outputs: DataFrame, row_id: str = ROW_ID) -> DataFrame:
    """Input rows whose id has no output, wherever in the table they are."""
    (done,) = spare(inputs, "done")
    ids = outputs.select(F.col(f"`{row_id}`").alias(done))
    same = F.col(f"`{row_id}`").eqNullSafe(F.col(done))
    return inputs.join(ids, same, "left_anti").select(*(F.col(f"`{c}`") for c in inputs.columns))


def not_done(inputs: DataFrame, outputs: DataFrame, row_id: str = ROW_ID) -> DataFrame:
    """``remaining``, which moves no cells unless very many of these rows are done.

    Only ids are compared first. Mostly none or few of them are in the output, and those are
    sent to where the rows are.
    """
    found = inputs.select(F.col(f"`{row_id}`")).distinct()
    (done,) = spare(found, "done")
    ids = outputs.select(F.col(f"`{row_id}`").alias(done))
    found = found.join(ids, F.col(f"`{row_id}`").eqNullSafe(F.col(done)), "left_semi")
    many = found.limit(BROADCAST_KEYS + 1).count()
    if not many:
        return inputs
    return remaining(inputs, F.broadcast(found) if many <= BROADCAST_KEYS else outputs, row_id)


def import_states(spark: SparkSession, path: str) -> DataFrame:
    """Job records from JSON files; what cannot be read counts as not begun."""
    return (
        spark.read.schema(f"{STATE_SCHEMA}, {CORRUPT} string")
        .options(mode="PERMISSIVE", columnNameOfCorruptRecord=CORRUPT, multiLine=True)
        .json(path)
        .where(F.col(CORRUPT).isNull() & F.col("dataset_id").isNotNull())
        .select(
            "dataset_id",
            F.coalesce("split", F.lit("train")).alias("split"),
            F.coalesce("columns", F.array().cast("array<string>")).alias("columns"),
            F.coalesce("total_rows", F.lit(0).cast("long")).alias("total_rows"),
            F.coalesce("completed_rows", F.lit(0).cast("long")).alias("completed_rows"),
            F.coalesce("last_saved_row", F.lit(-1).cast("long")).alias("last_saved_row"),
            F.try_to_timestamp("timestamp").alias("updated_at"),
        )
    )
