"""Saved tables: Parquet is the store, CSV an export.

The CSV reads back the same, but for empty cells, which it cannot tell from null.
"""

from __future__ import annotations

import warnings

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from glossa.functions.text import safe_name_of
from glossa.operators.cells import as_text
from glossa.operators.rows import ROW_ID, assign_row_id, first_n, scan_head
from glossa.session import FileSystem

# Quotes inside a cell are doubled, cells may hold line breaks, blanks are kept.
CSV_OPTIONS = {
    "header": True,
    "multiLine": True,
    "escape": '"',
    "ignoreLeadingWhiteSpace": False,
    "ignoreTrailingWhiteSpace": False,
}


def read_table(
    spark: SparkSession,
    path: str,
    schema: T.StructType | str | None = None,
    multi_line: bool = True,
) -> DataFrame:
    """Parquet for a path that ends in .parquet, UTF-8 CSV for any other.

    Without a schema all CSV columns are text: guessing types would read the
    whole file once more, and could change what a cell says. A CSV file is read
    by one task as long as its cells may hold line breaks; if they hold none,
    ``multi_line=False`` lets Spark split it.
    """
    if path.rstrip("/").endswith(".parquet"):
        return spark.read.schema(schema).parquet(path) if schema else spark.read.parquet(path)
    reader = spark.read.options(**{**CSV_OPTIONS, "multiLine": multi_line})
    return (reader.schema(schema) if schema else reader).csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    flat = df.select(
        *(
            as_text(df, f.name).alias(f.name)
            if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))
            else F.col(f"`{f.name}`")
            for f in df.schema
        )
    )
    options = {k: v for k, v in CSV_OPTIONS.items() if k != "multiLine"}
    flat.write.mode("overwrite").options(**options).csv(path)


def table_path(root: str, name: str, kind: str = "parquet") -> str:
    return f"{root.rstrip('/')}/{safe_name_of(name)}.{kind}"


def write_table(df: DataFrame, root: str, name: str, csv: bool = True) -> str:
    """Save as Parquet and, if wanted, CSV; gives back the Parquet path."""
    path = table_path(root, name)
    df.write.mode("overwrite").parquet(path)
    if csv:
        stored = df.sparkSession.read.schema(df.schema).parquet(path)
        write_csv(stored, table_path(root, name, "csv"))
    return path


def ingest_table(df: DataFrame, root: str, name: str) -> str:
    """Save a scanned Parquet table with the position of every row in it."""
    return write_table(assign_row_id(df), root, name, csv=False)


def reslice_cached(
    spark: SparkSession, root: str, name: str, n: int | None, row_id: str = ROW_ID
) -> DataFrame:
    """Cut a saved table to its first ``n`` rows, for good, if it has more.

    The cut is written beside the table and takes its place by a rename: a table
    cannot be overwritten while it is read.
    """
    path = table_path(root, name)
    fs = FileSystem(spark, path)
    fs.recover(path)
    saved = read_table(spark, path)
    if not n or n <= 0:
        return saved
    if row_id in saved.columns:
        cut, longer = first_n(saved, n, row_id), not saved.where(F.col(row_id) >= n).isEmpty()
    else:
        cut, longer = scan_head(saved, n), saved.count() > n
    if longer:
        cut.write.mode("overwrite").parquet(f"{path}.new")
        fs.replace(path, f"{path}.new")
        spark.catalog.refreshByPath(path)
        saved = read_table(spark, path)
    return saved


def catalog(spark: SparkSession, root: str) -> DataFrame:
    """(name, path, columns, row_count) of every saved table, by name.

    Rows of all tables are counted in one scan without data columns. If that meets a
    file it cannot read, they are counted one by one, and a table that cannot be read
    is left out, with a warning. A CSV table counts where there is no Parquet of its name.
    """
    fs = FileSystem(spark, root)
    folders = fs.folders(root)
    stored = {f.removesuffix(".parquet") for f in folders if f.endswith(".parquet")}
    found: dict[str, tuple[str, list[str], str]] = {}
    counts: dict[str, int] = {}
    for folder in folders:
        path = f"{root.rstrip('/')}/{folder}"
        name, _, kind = folder.rpartition(".")
        try:
            if kind == "parquet":
                found[name] = (path, spark.read.parquet(path).columns, fs.encoded(path))
            elif kind == "csv" and name not in stored:
                table = read_table(spark, path)
                found[name] = (path, table.columns, "")
                counts[name] = table.count()
        except (PySparkException, Py4JJavaError) as e:
            warnings.warn(f"could not read {path}: {type(e).__name__}", stacklevel=2)
    names = {place: name for name, (_, _, place) in found.items() if place}
    try:
        counts |= _row_counts(spark, [found[n][0] for n in names.values()], names)
    except (PySparkException, Py4JJavaError):
        for place, name in names.items():
            try:
                counts |= _row_counts(spark, [found[name][0]], {place: name})
            except (PySparkException, Py4JJavaError) as e:
                del found[name]
                warnings.warn(f"could not read {name}: {type(e).__name__}", stacklevel=2)
    rows = [(n, path, columns, counts.get(n, 0)) for n, (path, columns, _) in sorted(found.items())]
    return spark.createDataFrame(
        rows, "name string, path string, columns array<string>, row_count long"
    )


def _row_counts(spark: SparkSession, paths: list[str], names: dict[str, str]) -> dict[str, int]:
    """Rows of each table by name; ``names`` has the names by folder."""
    if not paths:
        return {}
    folder = r"^(?:[^:/]+:(?://[^/]*)?)?(/.*)/[^/]+$"
    rows = (
        spark.read.schema(T.StructType([]))
        .parquet(*paths)
        .groupBy(F.regexp_extract("_metadata.file_path", folder, 1).alias("folder"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return {names[r["folder"]]: r["n"] for r in rows.collect()}
