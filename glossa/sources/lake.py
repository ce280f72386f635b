"""Datasets with splits, as folders ``dataset=…/split=…``."""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from glossa.functions.text import safe_name_of
from glossa.operators.rows import ROW_ID, lowest, scan_head
from glossa.session import FileSystem, folder_value

DEFAULT_SPLIT = "train"


def dataset_path(root: str, dataset: str) -> str:
    return f"{root.rstrip('/')}/dataset={folder_value(safe_name_of(dataset))}"


def write_splits(df: DataFrame, root: str, dataset: str, split: Column | str) -> str:
    """Save a dataset with one folder per value of ``split``."""
    c = F.col(split) if isinstance(split, str) else split
    path = dataset_path(root, dataset)
    df.withColumn("split", c).write.mode("overwrite").partitionBy("split").parquet(path)
    return path


def load_split(
    spark: SparkSession, root: str, dataset: str, split: str | None = None, limit: int | None = None
) -> DataFrame:
    """One split, whole or its first ``limit`` rows in source order.

    Only the folder of that split is read.
    """
    name = split or default_split(spark, root, dataset)
    df = spark.read.parquet(f"{dataset_path(root, dataset)}/split={folder_value(name)}")
    if not limit or limit <= 0:
        return df
    if ROW_ID in df.columns:
        # Positions may be those of the table the split was cut from.
        return lowest(df, limit)
    return scan_head(df, limit)


def split_names(spark: SparkSession, root: str, dataset: str) -> list[str]:
    """Names of the split folders; no data is read."""
    path = dataset_path(root, dataset)
    folders = FileSystem(spark, path).folders(path)
    found = sorted(unquote(f.removeprefix("split=")) for f in folders if f.startswith("split="))
    return found or [DEFAULT_SPLIT]


def default_split(spark: SparkSession, root: str, dataset: str) -> str:
    names = split_names(spark, root, dataset)
    return DEFAULT_SPLIT if DEFAULT_SPLIT in names else names[0]


def list_splits(spark: SparkSession, root: str, dataset: str) -> DataFrame:
    """(split, is_default)."""
    chosen = default_split(spark, root, dataset)
    rows = [(name, name == chosen) for name in split_names(spark, root, dataset)]
    return spark.createDataFrame(rows, "split string, is_default boolean")
