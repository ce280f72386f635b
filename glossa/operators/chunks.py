"""Texts to chunks and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from glossa.functions.deep import deep_chunks_udf, shallow_chunks
from glossa.functions.text import estimate_tokens
from glossa.settings import char_budget


def chunk_array(df: DataFrame, text: str, max_tokens: int, into: str = "chunks") -> DataFrame:
    """Add the list of chunks of ``text``."""
    shallow = df.withColumn("_shallow", shallow_chunks(F.col(text), max_tokens))
    deep = deep_chunks_udf(char_budget(max_tokens))
    left = F.when(F.col("_shallow").isNull(), F.col(text))
    return shallow.withColumn(into, F.coalesce(F.col("_shallow"), deep(left))).drop("_shallow")


def chunk_table(df: DataFrame, text: str, max_tokens: int) -> DataFrame:
    """One row (…, chunk_idx, chunk, est_tokens) per chunk, in place of ``text``."""
    kept = [c for c in df.columns if c != text]
    chunked = chunk_array(df, text, max_tokens, "_chunks")
    # The inner form would make the optimizer add a filter that chunks every text
    # a second time. The list is never empty, so both forms give the same rows.
    return chunked.select(
        *kept, F.posexplode_outer("_chunks").alias("chunk_idx", "chunk")
    ).withColumn("est_tokens", estimate_tokens("chunk"))


def join_chunks(df: DataFrame, keys: list[str], chunk: str, into: str = "text") -> DataFrame:
    """Put the chunks of a text together again, one space between them.

    A group is one text, so its size is that of a cell.
    """
    ordered = F.array_sort(F.collect_list(F.struct("chunk_idx", F.col(chunk).alias("piece"))))
    return df.groupBy(*keys).agg(joined(ordered).alias(into))


def joined(pieces: Column) -> Column:
    return F.array_join(F.transform(pieces, lambda p: p["piece"]), " ")
