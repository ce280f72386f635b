"""What is in a table: counts per column, JSON shape, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from glossa.functions.jsoncell import json_keys
from glossa.operators.cells import as_text, text_columns
from glossa.operators.rows import rank_rows
from glossa.session import WorkFolder
from glossa.settings import SKIP_KEYS, TRANSLATE_KEYS

# Longer values are compared by their SHA-256, so that texts need not be shuffled.
SHORT_VALUE = 64

# A line of the column report lists so many keys, at most.
KEYS_PER_LINE = 200


def row_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("row_count"))


def _columns(df: DataFrame, rows: list[tuple], schema: str) -> DataFrame:
    return F.broadcast(df.sparkSession.createDataFrame(rows, schema))


def column_value(df: DataFrame, field: T.StructField) -> Column:
    """A cell as text in which equal values, and only those, are equal; NaN is null."""
    c = F.col(f"`{field.name}`")
    if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
        c = F.nanvl(c, F.lit(None)) + F.lit(0.0).cast(field.dataType)  # -0.0 becomes 0.0
        return c.cast("string")
    if isinstance(field.dataType, T.BinaryType):
        return F.sha2(c, 256)
    text = as_text(df, field.name)
    # The mark keeps a text apart from a cell that holds its digest.
    short = F.concat(F.lit("="), text)
    return F.when(F.length(text) <= SHORT_VALUE, short).otherwise(F.concat(F.lit("#"), F.sha2(text, 256)))


def column_stats(df: DataFrame, approx: bool = False) -> DataFrame:
    """Per column: position, name, type, non-null count and distinct count.

    All columns are counted in one scan and one shuffle of (column, value) pairs
    that were already combined; ``approx`` needs no shuffle of values at all.
    """
    fields = df.schema.fields
    names = _columns(
        df,
        [(i, f.name, f.dataType.simpleString()) for i, f in enumerate(fields)],
        "position int, column string, type string",
    )
    values = df.select(*(column_value(df, f).alias(f"c{i}") for i, f in enumerate(fields)))
    cells = F.explode(
        F.array(
            *(
                F.struct(F.lit(i).alias("position"), F.col(f"c{i}").alias("value"))
                for i in range(len(fields))
            )
        )
    )
    long = values.select(cells.alias("c")).select("c.*").where(F.col("value").isNotNull())
    if approx:
        counted = long.groupBy("position").agg(
            F.count("value").alias("non_null"),
            F.approx_count_distinct("value", 0.01).alias("distinct_values"),
        )
    else:
        counted = (
            long.groupBy("position", "value")
            .agg(F.count(F.lit(1)).alias("n"))
            .groupBy("position")
            .agg(F.sum("n").alias("non_null"), F.count(F.lit(1)).alias("distinct_values"))
        )
    return names.join(counted, "position", "left").select(
        "position",
        "column",
        "type",
        F.coalesce("non_null", F.lit(0).cast("long")).alias("non_null"),
        F.coalesce("distinct_values", F.lit(0).cast("long")).alias("distinct_values"),
    )


def _json_cells(df: DataFrame, columns: list[str] | None):
    """(column, keys) per text cell; keys is null unless the cell is JSON."""
    names = text_columns(df) if columns is None else columns
    if not names:
        raise ValueError("no text columns")
    texts = df.select(*(as_text(df, c).alias(c) for c in names))
    cells = texts.unpivot([], [f"`{c}`" for c in names], "column", "cell")
    return cells.select("column", json_keys("cell").alias("keys"))


def json_profile(
    df: DataFrame,
    columns: list[str] | None = None,
) -> DataFrame:
    """Per text column: rows, and how many of them hold a JSON object or array."""
    return _json_cells(df, columns).groupBy("column").agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.count("keys").alias("json_rows"),
    )


def json_key_table(
    df: DataFrame,
    columns: list[str] | None = None,
) -> DataFrame:
    """Distinct (column, key) over the top-level keys of all JSON cells."""
    found = _json_cells(df, columns)
    return (
        found.select("column", F.explode_outer("keys").alias("key"))
        .where(F.col("key").isNotNull())
        .distinct()
    )


def _key_counts(cells: DataFrame) -> DataFrame:
    """Distinct (column, key) and, under a null key, the rows of each column."""
    row = F.array(
        F.struct(
            F.lit(None).cast("string").alias("key"),
            F.lit(1).alias("row"),
            F.col("keys").isNotNull().cast("int").alias("json"),
        )
    )
    each = F.transform(
        F.coalesce("keys", F.array().cast("array<string>")),
        lambda k: F.struct(k.alias("key"), F.lit(0).alias("row"), F.lit(0).alias("json")),
    )
    return (
        cells.select("column", F.explode_outer(F.concat(row, each)).alias("e"))
        .groupBy("column", F.col("e.key").alias("key"))
        .agg(F.sum("e.row").alias("total_rows"), F.sum("e.json").alias("json_rows"))
    )


def classify_keys(
    keys: DataFrame,
    translate_keys: tuple[str, ...] = TRANSLATE_KEYS,
    skip_keys: tuple[str, ...] = SKIP_KEYS,
) -> DataFrame:
    """One row (column, key, kind) per key and kind; a key in both lists has two."""
    kinds = F.array_compact(
        F.array(
            F.when(F.col("key").isin(*translate_keys), "translate"),
            F.when(F.col("key").isin(*skip_keys), "skip"),
        )
    )
    kinds = F.when(F.size(kinds) > 0, kinds).otherwise(F.array(F.lit("untouched")))
    return keys.select("*", F.explode_outer(kinds).alias("kind"))


def column_report(
    df: DataFrame,
    columns: list[str] | None = None,
    translate_keys: tuple[str, ...] = TRANSLATE_KEYS,
    skip_keys: tuple[str, ...] = SKIP_KEYS,
    work: WorkFolder | None = None,
) -> DataFrame:
    """Lines (column, section, part, line) that tell a reader what is in each column.

    A long key list is spread over several lines in the order of the keys, so that no
    task ever has to hold all keys of a column. The distinct keys are stored, as they
    are used more than once and the cells should be parsed once.
    """
    work = work or WorkFolder(df.sparkSession)
    counted = work.write(
        _key_counts(_json_cells(df, columns)), "keys"
    )
    profile = counted.where(F.col("key").isNull())
    share = F.format_string("%s: JSON detected (%d/%d rows)", "column", "json_rows", "total_rows")
    plain = F.concat("column", F.lit(": plain text"))
    heads = profile.select(
        "column",
        F.lit(0).alias("section"),
        F.lit(0).cast("long").alias("part"),
        F.when(F.col("json_rows") > 0, share).otherwise(plain).alias("line"),
    )
    found = counted.where(F.col("key").isNotNull()).select("column", "key")
    kinds = classify_keys(found, translate_keys, skip_keys)
    order = ["column", "kind", "key"]
    ranked = rank_rows(kinds.select(*order), order, work, "kinds")
    # At most three rows per column.
    first = F.broadcast(ranked.groupBy("column", "kind").agg(F.min("rank").alias("first")))
    part = F.expr(f"(rank - first) div {KEYS_PER_LINE}")
    parts = ranked.join(first, ["column", "kind"]).withColumn("part", part)
    title = F.concat(F.upper(F.substring("kind", 1, 1)), F.expr("substring(kind, 2)"))
    listed = F.array_join(F.array_sort(F.collect_list("key")), ", ")
    key_lines = parts.groupBy("column", "kind", "part").agg(listed.alias("keys")).select(
        "column",
        F.when(F.col("kind") == "translate", 1)
        .when(F.col("kind") == "skip", 2)
        .otherwise(3)
        .alias("section"),
        "part",
        F.concat(title, F.lit(": "), "keys").alias("line"),
    )
    return heads.unionByName(key_lines)


# ------------------------------------------------------------------------ card


def _table(head: list[str], rows: list[list]) -> str:
    def line(cells: list) -> str:
        shown = (str(c).replace("|", "\\|").replace("\n", "<br>") for c in cells)
        return "| " + " | ".join(shown) + " |"

    return "\n".join([line(head), line(["---"] * len(head)), *(line(r) for r in rows)])


def dataset_card(
    df: DataFrame,
    name: str,
    source_dataset: str,
    language: str = "tr",
    row_id: str = "row_id",
    approx: bool = False,
    stats: DataFrame | None = None,
) -> str:
    """A Markdown card: front matter, origin, columns, three sample rows, how to read it.

    The work on the data is done by ``column_stats``; only its row per column and
    the three samples come to the driver. ``stats`` replaces it, as by the sketches of
    the batches of a growing table, which is then not read at all but for the samples.
    """
    shown = df.drop(row_id) if row_id in df.columns else df
    counts = column_stats(shown, approx) if stats is None else stats
    counts = counts.where(F.col("column") != row_id).orderBy("position").collect()
    samples = (
        df.orderBy(row_id).limit(3).select(*shown.columns).collect()
        if row_id in df.columns
        else df.take(3)
    )
    about = "about " if approx or stats is not None else ""
    columns = _table(
        ["column", "type", "filled cells", "different values"],
        [[s["column"], s["type"], s["non_null"], f"{about}{s['distinct_values']}"] for s in counts],
    )
    sample = _table(shown.columns, [list(r) for r in samples])
    return f"""---
language: {language}
license: mit
---

# {name}

Rows of `{source_dataset}` in which chosen columns were machine-translated; the target
language is `{language}`. Protected keys of JSON cells and all other columns are unchanged.

## Columns

{columns}

## First rows

{sample}

## How to read it

    spark.read.parquet("{name}")
"""
