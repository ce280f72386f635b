"""What the operators of this subpackage share: words, numbering and small driver reads."""

from __future__ import annotations

import sys
from collections.abc import Sequence
from types import ModuleType
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from glossa.session import WorkFolder

#: A word: a run of anything but the blank and the controls from tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"

#: The partition of a row in the numbers of ``monotonically_increasing_id``.
ID_BITS = 33


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def work(spark: SparkSession) -> WorkFolder:
    """A new folder for tables that cut the lineage, in the place all executors share.

    What a query returns may read these tables, so they stay until the folder of the
    cluster is emptied or the caller drops them.
    """
    return WorkFolder(spark)


def word_count(text: Column) -> Column:
    """Number of words, as a long; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def spare(df: DataFrame, *wanted: str) -> list[str]:
    """Names like the wanted ones that no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    made = []
    for name in wanted:
        free = f"_{name}"
        while free in taken:
            free = f"_{free}"
        made.append(free)
    return made


def ranked(df: DataFrame, order: Sequence[str], folder: WorkFolder, name: str) -> DataFrame:
    """``df`` with ``rank``, from 0 in the order of the given columns.

    Ranges are sorted apart and numbered within; the counts of the ranges, one row for
    each partition, give the offsets. No row passes through a single task.
    """
    parts = df.repartitionByRange(*order).sortWithinPartitions(*order)
    kept = folder.write(parts.withColumn("_id", F.monotonically_increasing_id()), name)
    kept = kept.withColumn("_part", F.shiftrightunsigned("_id", ID_BITS))
    counts = kept.groupBy("_part").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    local = F.col("_id") - F.shiftleft(F.col("_part"), ID_BITS)
    return (
        kept.join(F.broadcast(offsets), "_part")
        .withColumn("rank", F.col("_off") + local)
        .drop("_part", "_id", "_off")
    )


def worker_state() -> dict[str, Any]:
    """What a Python worker keeps between tasks.

    Functions are shipped by value, so globals of their modules last for one task only.
    """
    name = "_glossa_worker"
    return sys.modules.setdefault(name, ModuleType(name)).__dict__
