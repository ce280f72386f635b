"""Lines that many documents share, dropped from all of them.

Lines are exploded with their position and brought to a key: blanks and controls from tab
to carriage return go at both ends, A to Z become small, and the key is hashed to 128 bits.
Distinct documents are counted for each hash; repeats within a task are dropped before the
shuffle, and a hash is counted in parts by document first, so a line that every document
holds is no single task's work. Hashes in ``min_documents`` documents or more lose their
lines. The positions to drop come back as one short list for each document, the other
positions are what is left of 0, 1, 2, ... without them, and the lines at these are joined.

Only hashes and positions are exploded and shuffled; texts move once, when they meet their
list. Frequent hashes are broadcast up to a checked number. Beyond it, those of more than a
ten-thousandth of all lines (at most ten thousand) are broadcast, and the others, none of
them hot, are joined by a shuffle. Columns only, no Python.

Defined cases: a null or empty text is one empty line; an empty key is shorter than
``min_chars`` and always stays, unless that is 0; rows equal in id are one document when
documents are counted, as are all rows without an id, and each row has its own result; a
document whose lines all go keeps the empty text; lines end at \\n alone, so a carriage
return belongs to its line; no rows give no rows. Further columns pass through, but for
those named like the ones added.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, functions as F

from glossa.llm.common import spare, work
from glossa.session import WorkFolder

BLANKS = " \t\n\x0b\x0c\r"

#: Frequent hashes that are sent to all executors: some 30 MB.
BROADCAST_HASHES = 300_000

#: A line with more than this share of all lines is hot.
HOT_LINES = 10_000

ADDED = ("n_lines", "n_dropped", "kept")
HASH = ["_h1", "_h2"]


def line_key(line: Column) -> Column:
    """The line as it is compared."""
    plain = F.octet_length(line) == F.char_length(line)
    small = F.when(plain, F.lower(line)).otherwise(
        F.translate(line, string.ascii_uppercase, string.ascii_lowercase)
    )
    return F.btrim(small, F.lit(BLANKS))


def hashed(*columns: Column) -> list[Column]:
    """128 bits as two longs; nulls are skipped, so give them a value before."""
    return [F.xxhash64(*columns), F.xxhash64(F.lit(1), *columns)]


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _rows(doc_id: str, text: str) -> list[Column]:
    """The hash of an id and a text: rows equal in both have the same lines."""
    held = F.col(doc_id)
    return hashed(held.isNull(), F.coalesce(held.cast("string"), F.lit("")), F.coalesce(text, F.lit("")))


def repeated_positions(
    docs: DataFrame, doc_id: str, text: str, min_documents: int, min_chars: int, folder: WorkFolder
) -> DataFrame:
    """(_r1, _r2, _at): positions to drop of each row that has any."""
    r1, r2 = _rows(doc_id, text)
    one = docs.select(
        r1.alias("_r1"), r2.alias("_r2"), F.struct(F.col(doc_id)).alias("_doc"),
        F.posexplode(lines_of(F.col(text))).alias("_pos", "_line"),
    )
    key = line_key(F.col("_line"))
    h1, h2 = hashed(F.col("_key"))
    lines = one.select("_r1", "_r2", "_doc", "_pos", key.alias("_key"))
    lines = lines.filter(F.char_length("_key") >= min_chars)
    lines = lines.select("_r1", "_r2", "_doc", "_pos", h1.alias("_h1"), h2.alias("_h2"))
    lines = folder.write(lines, "lines")
    counts = lines.groupBy(*HASH).agg(
        F.count_distinct("_doc").alias("_docs"), F.count("*").alias("_n")
    )
    frequent = counts.filter(F.col("_docs") >= min_documents).select(*HASH, "_n")
    placed = _matching(lines, folder.write(frequent, "frequent"))
    return placed.groupBy("_r1", "_r2").agg(F.collect_set("_pos").alias("_at"))


def _matching(lines: DataFrame, frequent: DataFrame) -> DataFrame:
    """The lines whose hash is frequent."""
    if frequent.count() <= BROADCAST_HASHES:
        return lines.join(F.broadcast(frequent), HASH, "left_semi")
    share = lines.count() / HOT_LINES
    hot = F.broadcast(frequent.filter(F.col("_n") > share))
    others = lines.join(hot, HASH, "left_anti")
    rare = frequent.filter(F.col("_n") <= share)
    return lines.join(hot, HASH, "left_semi").union(others.join(rare, HASH, "left_semi"))


def drop_repeated_lines(
    docs: DataFrame,
    *,
    min_documents: int = 10,
    min_chars: int = 1,
    doc_id: str = "doc_id",
    text: str = "text",
    folder: WorkFolder | None = None,
) -> DataFrame:
    """``docs`` with ``n_lines`` (before), ``n_dropped`` and ``kept``, the text that is left."""
    folder = folder or work(docs.sparkSession)
    drops = repeated_positions(docs, doc_id, text, min_documents, min_chars, folder)
    names = [c for c in docs.columns if c.lower() not in ADDED]
    lines, r1, r2, d1, d2, at = spare(docs, "lines", "r1", "r2", "d1", "d2", "at")
    drops = drops.toDF(d1, d2, at)
    first, second = _rows(doc_id, text)
    # The lines are cut below the join: above it, they would be cut again for each position.
    left = docs.withColumns({r1: first, r2: second, lines: lines_of(F.col(text))})
    both = left.join(drops, (F.col(r1) == F.col(d1)) & (F.col(r2) == F.col(d2)), "left")
    n, gone = F.size(lines), F.coalesce(at, F.array().cast("array<int>"))
    stay = F.array_except(F.sequence(F.lit(0), n - 1), gone)
    kept = F.array_join(F.transform(stay, lambda i: F.get(lines, i)), "\n")
    return both.select(
        *[F.col(f"`{c}`") for c in names], n.cast("long").alias("n_lines"),
        F.size(gone).cast("long").alias("n_dropped"), kept.alias("kept"),
    )
