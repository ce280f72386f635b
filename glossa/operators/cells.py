"""Columns as cells: choosing, unpivoting, routing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from glossa.functions.jsoncell import is_json_cell
from glossa.functions.text import double_text, is_translatable

COMPLEX = (T.ArrayType, T.MapType, T.StructType)


def spare(df: DataFrame, *wanted: str) -> list[str]:
    """Names like the wanted ones that no column of ``df`` has, in any case."""
    taken = {c.lower() for c in df.columns}
    made = []
    for name in wanted:
        free = f"_{name}"
        while free in taken:
            free = f"_{free}"
        made.append(free)
    return made


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]


def chosen_columns(df: DataFrame, columns: list[str]) -> list[str]:
    """``columns`` if there are any and the table has them all."""
    if not columns:
        raise ValueError("no columns selected")
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"no such columns: {', '.join(missing)}")
    return list(dict.fromkeys(columns))


def select_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*(F.col(f"`{c}`") for c in chosen_columns(df, columns)))


def columns_summary(columns: list[str]) -> str:
    if not columns:
        return "No columns selected"
    return f"{len(columns)} column(s) selected: {', '.join(columns)}"


def as_text(df: DataFrame, column: str) -> Column:
    """A cell as text; null stays null, nested values become JSON.

    Numbers and truth values look as in Python. NaN is null.
    """
    c = F.col(f"`{column}`")
    kind = df.schema[column].dataType
    if isinstance(kind, COMPLEX):
        return F.to_json(c, {"ignoreNullFields": "false"})
    if isinstance(kind, T.DoubleType):
        return double_text(c)
    if isinstance(kind, T.BooleanType):
        return F.initcap(c.cast("string"))
    return c.cast("string")


def unpivot_cells(df: DataFrame, row_id: str, columns: list[str]) -> DataFrame:
    """One row (row_id, column, cell) per cell, so all columns share later stages."""
    names = chosen_columns(df, columns)
    texts = df.select(F.col(row_id), *(as_text(df, c).alias(c) for c in names))
    return texts.unpivot(row_id, [f"`{c}`" for c in names], "column", "cell")


def route_cell(cell: Column, json_mode: str = "auto") -> Column:
    """'skip' for blank cells, 'json' for JSON cells, else 'plain'.

    Modes auto and force agree for every cell: whatever is no object or array is
    translated as plain text in both.
    """
    plain = F.when(~is_translatable(cell), "skip")
    if json_mode != "off":
        plain = plain.when(is_json_cell(cell), "json")
    return plain.otherwise("plain")


def replace_columns(df: DataFrame, new: dict[str, Column]) -> DataFrame:
    """Put new values into some columns; all others, and the order, stay."""
    return df.select(*(new[c].alias(c) if c in new else F.col(f"`{c}`") for c in df.columns))
