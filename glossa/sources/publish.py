"""Hand a finished table over, with its card."""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import DataFrame, SparkSession

from glossa.operators.profile import dataset_card
from glossa.session import FileSystem


def publish_card(spark: SparkSession, text: str, target: str) -> str:
    """Put the card beside the data, as the file README.md."""
    path = f"{target.rstrip('/')}/README.md"
    aside = f"{target.rstrip('/')}/.README-{uuid.uuid4().hex}"
    # The writer ends the last line itself.
    card = spark.createDataFrame([(text.removesuffix("\n"),)], "value string").coalesce(1)
    card.write.option("lineSep", "\n").text(aside)
    fs = FileSystem(spark, target)
    try:
        (part,) = [n for n in fs.files(aside) if n.startswith("part-")]
        fs.delete(path)
        fs.rename(f"{aside}/{part}", path)
    finally:
        fs.delete(aside)
    return path


def publish(
    spark: SparkSession,
    table: str | DataFrame,
    target: str,
    source_dataset: str,
    language: str = "tr",
    row_id: str = "row_id",
    approx: bool = False,
) -> tuple[bool, str]:
    """Write a table and its card below ``target``: (True, target) or (False, why).

    ``target`` is any folder Spark can write to; the table goes to ``data``.
    ``approx`` counts distinct values in the card without a shuffle.
    """
    if not target.strip():
        return False, "no target given"
    try:
        df = spark.read.parquet(table) if isinstance(table, str) else table
    except AnalysisException as e:
        return False, f"table not found: {table} ({e.getCondition()})"
    data = f"{target.rstrip('/')}/data"
    try:
        df.write.mode("overwrite").parquet(data)
        stored = spark.read.schema(df.schema).parquet(data)
        card = dataset_card(stored, target, source_dataset, language, row_id, approx)
        publish_card(spark, card, target)
    except (PySparkException, Py4JJavaError, OSError) as e:
        return False, f"could not publish: {type(e).__name__}: {str(e)[:500]}"
    return True, target
