"""Row positions, and what depends on them."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from glossa.operators.cells import spare
from glossa.session import FileSystem, WorkFolder

ROW_ID = "row_id"

# So many files are summed in one window.
SMALL_FILE_COUNT = 100_000

# Offsets of so many files are sent to all executors at once, as hash and position: some
# 40 MB. A table of more files, over 100 TB, is read in as many ranges of file names.
FILES_PER_SCAN = 1_000_000

# Slices of a range of positions that are counted at once.
SLICES = 4096

# Tables up to this size are worth a shuffle to get all cores to work.
SMALL_TABLE_BYTES = 1 << 30


def _rows_per_file(df: DataFrame) -> DataFrame:
    return (
        df.select(F.col("_metadata.file_path").alias("file"))
        .groupBy("file")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def _offsets_by_window(files: DataFrame) -> DataFrame:
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    return files.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0)))


def _offsets_by_range(
    spark: SparkSession, files: DataFrame, work: WorkFolder, ranges: int
) -> DataFrame:
    """Running sums inside ranges of file names, on top of the sums of the ranges; stored."""
    ranged = files.repartitionByRange(ranges, "file")
    stored = work.write(ranged.withColumn("part", F.spark_partition_id()), "file_ranges")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = stored.groupBy("part").agg(F.sum("n").alias("size")).select(
        "part", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("start")
    )
    inside = Window.partitionBy("part").orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        stored.withColumn("inner", F.coalesce(F.sum("n").over(inside), F.lit(0)))
        .join(F.broadcast(parts), "part")
        .select("part", "file", (F.col("start") + F.col("inner")).alias("base"))
    )
    return work.write(offsets, "file_offsets")


def _name_ranges(offsets: DataFrame, files_per_scan: int) -> list[tuple[str, str]]:
    """First and last names of runs of ranges with about so many files."""
    parts = offsets.groupBy("part").agg(
        F.count(F.lit(1)).alias("n"), F.min("file").alias("first"), F.max("file").alias("last")
    )
    runs: list[list] = []
    for part in parts.orderBy("part").collect():  # a few for each core of the cluster
        if runs and runs[-1][0] + part["n"] <= files_per_scan:
            runs[-1][0] += part["n"]
            runs[-1][2] = part["last"]
        else:
            runs.append([part["n"], part["first"], part["last"]])
    return [(first, last) for _, first, last in runs]


def _telling_hash(offsets: DataFrame) -> int:
    """A number that, hashed with the names, tells all files apart."""
    for seed in range(100):
        named = F.xxhash64(F.lit(seed), "file")
        sums = offsets.select(named.alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("n"))
        if sums.where(F.col("n") > 1).isEmpty():
            return seed
    raise RuntimeError("no hash tells the files apart")


def file_path() -> Column:
    return F.col("_metadata.file_path")


def file_names(df: DataFrame) -> list[str]:
    """The files of a scan in order, as the scan names them: a scheme without a host has
    one slash."""
    return sorted({re.sub(r"^([\w+.-]+):///", r"\1:/", name) for name in df.inputFiles()})


def assign_row_id(
    df: DataFrame,
    small_file_count: int = SMALL_FILE_COUNT,
    work: WorkFolder | None = None,
    files_per_scan: int = FILES_PER_SCAN,
) -> DataFrame:
    """Number the rows of a Parquet table in file order, from 0 without gaps.

    ``df`` must be a scan, with at most filters on partition columns. Row counts
    per file come from a scan without data columns. No row is shuffled: the offsets
    of up to ``files_per_scan`` files are sent to where these files are read, and a
    table of more files is the union of scans of as many.
    """
    spark = df.sparkSession
    files = _rows_per_file(df)
    many = len(df.inputFiles())
    if many <= small_file_count:
        offsets = _offsets_by_window(files)
        return _numbered(df, offsets, file_path(), F.col("file"))
    ranges = max(spark.sparkContext.defaultParallelism * 4, -(-2 * many // files_per_scan))
    offsets = _offsets_by_range(spark, files, work or WorkFolder(spark), ranges)
    seed = F.lit(_telling_hash(offsets))
    runs = _name_ranges(offsets, files_per_scan)
    if len(runs) <= 1:
        scans = [(df, offsets)]
    else:
        scans = [
            (df.where(file_path().between(*run)), offsets.where(F.col("file").between(*run)))
            for run in runs
        ]
    numbered = [
        _numbered(scan, mine, F.xxhash64(seed, file_path()), F.xxhash64(seed, "file"))
        for scan, mine in scans
    ]
    return reduce(DataFrame.union, numbered)


def _numbered(df: DataFrame, offsets: DataFrame, here: Column, there: Column) -> DataFrame:
    """Rows with the offset of their file, found by equal names, and their place in it."""
    file, index, base = spare(df, "file", "index", "base")
    bases = F.broadcast(offsets.select(there.alias(file), F.col("base").alias(base)))
    placed = df.select("*", here.alias(file), F.col("_metadata.row_index").alias(index))
    return placed.join(bases, file).select(
        (F.col(base) + F.col(index)).alias(ROW_ID), *(F.col(f"`{c}`") for c in df.columns)
    )


def rank_rows(df: DataFrame, order: list[str], work: WorkFolder, name: str) -> DataFrame:
    """Add ``rank``, from 0 in the given order: ranges are sorted, then numbered apart."""
    ranges = df.repartitionByRange(*order).sortWithinPartitions(*order)
    stored = work.write(ranges.withColumn("_id", F.monotonically_increasing_id()), name)
    part = F.shiftrightunsigned("_id", 33)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        stored.groupBy(part.alias("_part"))
        .agg(F.count(F.lit(1)).alias("_n"))
        .select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    )
    inside = F.col("_id") - F.shiftleft("_part", 33)
    return (
        stored.withColumn("_part", part)
        .join(F.broadcast(starts), "_part")
        .select(*df.columns, (F.col("_start") + inside).alias("rank"))
    )


def first_n(df: DataFrame, n: int | None, row_id: str = ROW_ID) -> DataFrame:
    """The first ``n`` rows in source order; None, 0 or less means all."""
    return df.where(F.col(row_id) < n) if n and n > 0 else df


def scan_head(df: DataFrame, n: int) -> DataFrame:
    """The first ``n`` rows of a Parquet table without positions, reading few files.

    Files are counted in the order of their names, one, then two, then four, until there
    are enough rows; no later file is opened.
    """
    names = file_names(df)
    at, size, rows, last = 0, 1, 0, None
    while at < len(names) and rows < n:
        run = names[at : at + size]
        counted = _rows_per_file(df.where(file_path().between(run[0], run[-1])))
        for file in counted.orderBy("file").collect():  # a part of the list of names
            if rows < n:
                rows, last = rows + file["n"], file["file"]
        at, size = at + size, size * 2
    if last is None:
        return df.limit(0)
    return first_n(assign_row_id(df.where(file_path() <= last)), n).drop(ROW_ID)


def lowest(df: DataFrame, n: int, order: str = ROW_ID) -> DataFrame:
    """The ``n`` rows with the lowest values of a whole number, nulls first.

    The value to cut at is found by counts of slices, each time of the one slice that has
    it, so a handful of passes over one column and a filter do, and no sort. Of rows that
    are equal in the value to cut at, any are taken. Other types than whole numbers are
    sorted.
    """
    c = F.col(f"`{order}`")
    if not isinstance(df.schema[order].dataType, T.IntegralType):
        return df.orderBy(c).limit(n)
    ends = df.agg(
        F.min(c).alias("low"), F.max(c).alias("high"), F.count(c).alias("valued"),
        F.count(F.lit(1)).alias("rows"),
    ).first()
    if ends["rows"] <= n:
        return df
    before = ends["rows"] - ends["valued"]
    if before >= n:
        return df.where(c.isNull()).limit(n)
    low, high = int(ends["low"]), int(ends["high"])
    while low < high:
        width = -(-(high - low + 1) // SLICES)
        place = F.expr(f"(cast(`{order}` as decimal(20, 0)) - ({low})) div {width}")
        slices = df.where(c.between(low, high)).groupBy(place.alias("slice"))
        counts = slices.agg(F.count(F.lit(1)).alias("n")).orderBy("slice").collect()
        for found in counts:  # at most SLICES rows
            if before + found["n"] >= n:
                break
            before += found["n"]
        low += found["slice"] * width
        high = min(high, low + width - 1)
        if before + found["n"] == n:
            return df.where(c.isNull() | (c <= high))
    less = df.where(c.isNull() | (c < low))
    return less.union(df.where(c == low).limit(n - before))


def rows_from(df: DataFrame, start: int, row_id: str = ROW_ID) -> DataFrame:
    """Rows from position ``start`` on."""
    return df.where(F.col(row_id) >= start)


def preview(df: DataFrame, n: int = 10, row_id: str = ROW_ID) -> DataFrame:
    """The first ``n`` rows, in order and without their position."""
    return first_n(df, n, row_id).orderBy(row_id).drop(row_id)


def spread_small(df: DataFrame, *by: str) -> DataFrame:
    """Spread a small table of few files over all cores, by the given columns.

    A file may be one row group, and then one task, whatever its texts cost. Tables
    of some size have enough row groups and are left as they are.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    files = df.inputFiles()
    if not files or len(files) >= cores:
        return df
    fs = FileSystem(spark, files[0])
    small = sum(fs.size(f) for f in files) <= SMALL_TABLE_BYTES
    return df.repartition(cores, *(F.col(f"`{c}`") for c in by)) if small else df


def empty_like(df: DataFrame) -> DataFrame:
    """No rows, same columns."""
    return df.limit(0)
