"""The strings to translate: whole plain cells, and leaves of JSON cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from glossa.functions.jsoncell import json_leaves
from glossa.functions.text import is_translatable
from glossa.settings import SKIP_KEYS, TRANSLATE_KEYS

PLAIN_PATH = "$"


def _inline(df: DataFrame, kept: list[str], found: Column) -> DataFrame:
    """Leaves as rows. The inner form would have the optimizer parse cells twice."""
    return df.select(*kept, F.inline_outer(found)).where(F.col("leaf_ord").isNotNull())


def explode_json_leaves(
    df: DataFrame,
    cell: str,
    translate_keys: tuple[str, ...] = TRANSLATE_KEYS,
    skip_keys: tuple[str, ...] = SKIP_KEYS,
) -> DataFrame:
    """One row (…, leaf_ord, path, text) per translatable string of JSON cells."""
    kept = [c for c in df.columns if c != cell]
    found = json_leaves(cell, translate_keys, skip_keys)
    return _inline(df, kept, found)


def leaf_table(
    cells: DataFrame,
    json_mode: str = "auto",
    translate_keys: tuple[str, ...] = TRANSLATE_KEYS,
    skip_keys: tuple[str, ...] = SKIP_KEYS,
    cell: str = "cell",
) -> DataFrame:
    """Leaves of all cells that hold text; a plain cell is its own only leaf."""
    kept = [c for c in cells.columns if c != cell]
    full = cells.where(is_translatable(cell))
    whole = F.array(
        F.struct(
            F.lit(0).alias("leaf_ord"), F.lit(PLAIN_PATH).alias("path"), F.col(cell).alias("text")
        )
    )
    if json_mode == "off":
        found = whole
    else:
        found = F.coalesce(json_leaves(cell, translate_keys, skip_keys), whole)
    return _inline(full, kept, found)
