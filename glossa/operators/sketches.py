"""Counts of a table that grows, from sketches of its batches.

A batch leaves one small row for each column: rows, values that are not null, and a
HyperLogLog sketch of the values. Rows of all batches merge into the counts of the whole
table, so a table of any age is counted without reading it again. Non-null counts are
exact. Distinct counts are estimates whose relative standard error is ``ERROR``; merging
adds nothing to it, as the sketch of a union is the union of the sketches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from glossa.operators.profile import column_value
from glossa.session import FileSystem, folder_value

# Two to this power registers: some 16 KB a column and batch.
LG_K = 14

# 1.04 / sqrt(registers)
ERROR = 0.0082

KINDS = "position int, column string, type string, rows long, non_null long, sketch binary"


def sketch_aggregates(df: DataFrame) -> list[Column]:
    """Aggregates of one pass over ``df``: ``rows``, and ``n0``, ``s0``, ... by column.

    They can be observed while the table is written, and then cost no pass at all.
    """
    made = [F.count(F.lit(1)).alias("rows")]
    for i, field in enumerate(df.schema):
        value = column_value(df, field)
        made += [F.count(value).alias(f"n{i}"), F.hll_sketch_agg(value, LG_K).alias(f"s{i}")]
    return made


def sketch_rows(df: DataFrame, counted: dict) -> list[tuple]:
    """Rows of ``KINDS`` from the values of ``sketch_aggregates``."""
    return [
        (i, f.name, f.dataType.simpleString(), counted["rows"], counted[f"n{i}"], counted[f"s{i}"])
        for i, f in enumerate(df.schema)
    ]


def column_sketches(df: DataFrame) -> DataFrame:
    """One row of ``KINDS`` for each column; values meet in tasks, only sketches leave them."""
    counted = df.agg(*sketch_aggregates(df))
    each = F.array(
        *(
            F.struct(
                F.lit(i).alias("position"), F.lit(f.name).alias("column"),
                F.lit(f.dataType.simpleString()).alias("type"), F.col("rows"),
                F.col(f"n{i}").alias("non_null"), F.col(f"s{i}").alias("sketch"),
            )
            for i, f in enumerate(df.schema)
        )
    )
    return counted.select(F.inline(each))


def store_sketches(sketches: DataFrame, root: str, batch: str) -> None:
    """Keep the sketches of a batch; a batch that is stored again replaces itself."""
    path = f"{root.rstrip('/')}/batch={folder_value(batch)}"
    sketches.coalesce(1).write.mode("overwrite").parquet(path)


def stored_sketches(spark: SparkSession, root: str) -> DataFrame:
    """The sketches of all batches, with the batch."""
    kinds = f"{KINDS}, batch string"
    if not FileSystem(spark, root).folders(root):
        return spark.createDataFrame([], kinds)
    return spark.read.schema(kinds).parquet(root)


def merged(sketches: DataFrame) -> DataFrame:
    """One row for each column of all batches. A column that some batches lack counts in
    those that have it.

    A sketch that was never merged is read by another estimator than a merged one; each is
    merged with itself first, so that one batch and many of the same rows give one number.
    """
    return sketches.groupBy("column", "type").agg(
        F.min("position").alias("position"), F.sum("rows").alias("rows"),
        F.sum("non_null").alias("non_null"),
        F.hll_union_agg(F.hll_union("sketch", "sketch")).alias("sketch"),
    )


def sketched_stats(sketches: DataFrame) -> DataFrame:
    """(position, column, type, non_null, distinct_values) as of ``column_stats``, and
    ``error``: the relative standard error of the distinct count."""
    found = merged(sketches)
    distinct = F.when(F.col("non_null") > 0, F.hll_sketch_estimate("sketch")).otherwise(F.lit(0))
    return found.select(
        "position", "column", "type", "non_null", distinct.cast("long").alias("distinct_values"),
        F.lit(ERROR).alias("error"),
    )
