"""Best-fit packing by minimum bin slack.

Documents become token ids; those over the capacity are cut so that all pieces but the
first are full. What decides the packing is only how many pieces there are of each
length, a histogram of at most ``capacity`` rows, so the plan for any number of documents
is made from that. Per bin, the plan starts with the longest length left and finds, with
a subset-sum table kept as bits of an integer, the fullest combination of the lengths
left that fits beside it. The combination is taken as often as the lengths last.

Pieces of one length are interchangeable: each gets a rank among those of its length,
and the plan says which bin and offset a rank has. Ranks are counted in slices, so a
length that a large share of the pieces has is not the work of one task.

Defined cases: a null text is empty and has the end id only; repeated rows are packed
each; no rows give no rows; further columns of the input are dropped.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from glossa.llm.common import work
from glossa.llm.tokenize import encoded

#: Pieces of one length whose ranks one task counts.
SLICE_PIECES = 5_000

PLAN = "length int, first long, bins long, copies int, base long, offset int"


def best_fill(counts: dict[int, int], room: int) -> list[int]:
    """The lengths, with repeats, of a combination that fills ``room`` best.

    Bit s of ``reach[i]`` says that some of the first i items add up to s. A length that
    is there k times enters as items of 1, 2, 4, ... copies, which make up any number to
    k. Long lengths come last, so that the way back from the best sum uses them first.
    """
    items: list[tuple[int, int]] = []
    for length in sorted(n for n, c in counts.items() if c > 0 and n <= room):
        left, step = min(counts[length], room // length), 1
        while left > 0:
            items.append((length, min(step, left)))
            left -= step
            step *= 2
    mask = (1 << (room + 1)) - 1
    reach = [1]
    for length, copies in items:
        reach.append(reach[-1] | (reach[-1] << (length * copies) & mask))
        if reach[-1] >> room:
            break
    total = reach[-1].bit_length() - 1
    chosen: list[int] = []
    for i in range(len(reach) - 1, 0, -1):
        if not reach[i - 1] >> total & 1:
            length, copies = items[i - 1]
            chosen += [length] * copies
            total -= length * copies
    return chosen


def pack_plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Rows of ``PLAN``: from rank ``first`` on, pieces of that length fill ``bins`` bins from
    number ``base``, ``copies`` in each, side by side from ``offset`` on."""
    left = {n: c for n, c in counts.items() if c > 0}
    if any(not 0 < n <= capacity for n in left):
        raise ValueError(f"lengths must be from 1 to {capacity}")
    used: Counter[int] = Counter()
    rows, base = [], 0
    while left:
        longest = max(left)
        left[longest] -= 1
        chosen = Counter(best_fill(left, capacity - longest))
        left[longest] += 1
        chosen[longest] += 1
        bins = min(left[n] // k for n, k in chosen.items())
        offset = 0
        for n, k in sorted(chosen.items(), reverse=True):
            rows.append((n, used[n], bins, k, base, offset))
            used[n] += bins * k
            offset += n * k
            left[n] -= bins * k
            if not left[n]:
                del left[n]
        base += bins
    return rows


def pieces(
    docs: DataFrame,
    tokenizer: str,
    *,
    end_id: int,
    capacity: int,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """One row for each piece: doc_id, piece, start, length, ids (packed 32-bit integers)."""
    schema = docs.select(F.col(doc_id).alias("doc_id")).schema
    schema = schema.add("piece", "integer").add("start", "long").add("length", "integer")
    schema = schema.add("ids", "binary")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, found in encoded(batches, tokenizer, end_id, "text"):
            rows: list[list] = [[], [], [], [], []]
            for row, raw in enumerate(found):
                size = len(raw) // 4
                bounds = [0, *range(size % capacity or capacity, size + 1, capacity)]
                for piece, (a, b) in enumerate(zip(bounds, bounds[1:])):
                    for column, value in zip(rows, (row, piece, a, b - a, raw[4 * a : 4 * b])):
                        column.append(value)
            owner = batch.column("doc_id").take(pa.array(rows[0], pa.int64()))
            rest = zip(rows[1:], (pa.int32(), pa.int64(), pa.int32(), pa.binary()))
            made = [owner, *(pa.array(values, kind) for values, kind in rest)]
            yield pa.RecordBatch.from_arrays(made, names=schema.names)

    narrow = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return narrow.mapInArrow(cut, schema)


def with_crc(df: DataFrame, ids: str = "ids") -> DataFrame:
    """``ids_crc32``, unsigned, of the packed ids."""
    return df.withColumn("ids_crc32", F.crc32(ids))


def pack(cut: DataFrame, capacity: int, order: tuple[str, ...] = ("doc_id", "piece")) -> DataFrame:
    """``cut``, a stored table with a ``length`` per row, with ``sequence_id`` and ``offset``."""
    spark = cut.sparkSession
    folder = work(spark)
    counts = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}
    plan = spark.createDataFrame(pack_plan(counts, capacity), PLAN)

    slices = spark.createDataFrame(
        [(n, -(-c // SLICE_PIECES)) for n, c in counts.items()], "length int, _slices long"
    )
    key = F.xxhash64(*order)
    dealt = cut.join(F.broadcast(slices), "length").withColumn("_slice", F.pmod(key, "_slices"))
    dealt = dealt.drop("_slices")
    inside = Window.partitionBy("length", "_slice").orderBy(*order)
    ranked = dealt.withColumn("_rank", F.row_number().over(inside) - 1)
    ahead = Window.partitionBy("length").orderBy("_slice")
    ahead = ahead.rowsBetween(Window.unboundedPreceding, -1)
    before = dealt.groupBy("length", "_slice").count()
    before = before.select(
        "length", "_slice", F.coalesce(F.sum("count").over(ahead), F.lit(0)).alias("_before")
    )
    before = folder.write(before, "before")
    ranked = ranked.join(before, ["length", "_slice"])
    ranked = ranked.withColumn("_rank", F.col("_rank") + F.col("_before"))
    plan = plan.select(
        F.col("length").alias("_length"), "first", "bins", "copies", "base",
        F.col("offset").alias("_from"),
    )
    nth = F.col("_rank") - F.col("first")
    covers = (nth >= 0) & (nth < F.col("bins") * F.col("copies"))
    placed = ranked.join(F.broadcast(plan), (F.col("length") == F.col("_length")) & covers)
    return placed.select(
        *cut.columns,
        (F.col("base") + F.floor(nth / F.col("copies"))).cast("long").alias("sequence_id"),
        (F.col("_from") + F.pmod(nth, "copies") * F.col("length")).cast("long").alias("offset"),
    )


def sequences(packed: DataFrame) -> DataFrame:
    """The packed ids of each sequence, of at most ``capacity`` tokens: sequence_id, ids."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(parts, F.lit(b""), lambda done, part: F.concat(done, part["ids"]))
    return packed.groupBy("sequence_id").agg(joined.alias("ids"))
