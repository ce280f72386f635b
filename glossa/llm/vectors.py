"""Vectors as packed doubles, in blocks of bounded size, and searches of blocks by blocks.

A query meets a block of candidates as two rows of a join; the scores of all their pairs
are one matrix product in a task, and only the best of each query leave it. Candidates of
one cell are dealt to as many blocks as their number asks for, so a cell, or one vector
that very many rows hold, is never the work of one task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from glossa.llm.common import ranked
from glossa.session import WorkFolder

#: Candidates in a block and queries in a block, about.
BLOCK_ROWS = 4_096
QUERY_ROWS = 2_048


def usable(
    df: DataFrame, vec_id: str, vector: str, of: Callable[[Column], Column], folder: WorkFolder
) -> DataFrame:
    """(name, v, vec_id): vectors of at least one component, all of them finite.

    ``of`` maps a component as a double. ``vec_id`` here is a number of the row, from 0 in
    the order of the ids (null last), so rows equal in id stay apart and ties by number are
    ties by id; ``name`` is the id itself.
    """
    good = F.forall(
        F.col("v"), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    )
    rows = df.select(F.col(vec_id).alias("name"), F.col(vector).alias("v"))
    rows = rows.filter((F.size("v") > 0) & good)
    rows = rows.withColumns(
        {
            "v": F.transform("v", lambda x: of(x.cast("double"))),
            "_none": F.col("name").isNull(), "_tie": F.monotonically_increasing_id(),
        }
    )
    numbered = ranked(rows, ["_none", "name", "_tie"], folder, "vectors")
    return numbered.select("name", "v", F.col("rank").alias("vec_id"))


def named(found: DataFrame, rows: DataFrame) -> DataFrame:
    """Results with the ids of their rows, (query_id, rank, vec_id, score)."""
    ids = rows.select("name", "vec_id")
    queries = ids.select(F.col("name").alias("_query"), F.col("vec_id").alias("query_id"))
    both = found.join(queries, "query_id").join(ids, "vec_id")
    return both.select(F.col("_query").alias("query_id"), "rank", F.col("name").alias("vec_id"), "score")


def matrices(ids: pa.Array, vectors: pa.Array) -> Iterator[tuple["np.ndarray", "np.ndarray", "np.ndarray"]]:  # noqa: F821
    """(rows, ids, matrix) for each dimension among a list column of doubles."""
    import numpy as np

    sizes = np.diff(vectors.offsets.to_numpy())
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    starts = np.cumsum(sizes) - sizes
    number = ids.to_numpy(zero_copy_only=False)
    for dim in np.unique(sizes):
        rows = np.flatnonzero(sizes == dim)
        at = (starts[rows][:, None] + np.arange(dim)).ravel()
        yield rows, number[rows], flat[at].reshape(-1, dim)


def per_row(df: DataFrame, fn, columns: dict[str, str]) -> DataFrame:
    """Add columns to (vec_id, v, ...) computed from all vectors of one dimension together.

    ``fn(ids, matrix)`` gives a list with a value of each added column for each row.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    added = StructType.fromDDL(", ".join(f"{name} {kind}" for name, kind in columns.items()))
    schema = StructType([*df.schema, *added])
    kinds = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, ids, x in matrices(batch.column("vec_id"), batch.column("v")):
                some = batch.take(pa.array(rows))
                made = fn(ids, x)
                more = [pa.array(made[n], kinds.field(n).type) for n in columns]
                yield pa.RecordBatch.from_arrays([*some.columns, *more], schema=kinds)

    return df.mapInArrow(run, schema)


def _blocks_of(key: str, blocks: dict[int, int]) -> Column:
    split = [(k, n) for k, n in blocks.items() if n > 1]
    if not split:
        return F.lit(1)
    table = F.create_map(*[F.lit(x) for pair in split for x in pair])
    return F.coalesce(F.element_at(table, F.col(key)), F.lit(1))


def blocked(rows: DataFrame, key: str, many: Column, name: str) -> DataFrame:
    """Rows (key, block, ``name``) of lists of (vec_id, v): the rows of each key in so many."""
    block = F.pmod(F.xxhash64("vec_id"), many).alias("block")
    listed = F.sort_array(F.collect_list(F.struct("vec_id", "v"))).alias(name)
    return rows.select(key, "vec_id", "v", block).groupBy(key, "block").agg(listed)


def meetings(
    sent: DataFrame, queries: int, placed: DataFrame, counts: dict[int, int], key: str,
    block_rows: int, query_rows: int,
) -> DataFrame:
    """Rows (queries, candidates): each block of queries with each block of candidates.

    Both are joined by key and block, so the blocks of a large cell are met in as many tasks.
    """
    blocks = _blocks_of(key, {k: -(-n // block_rows) for k, n in counts.items()})
    asked = blocked(sent, key, F.lit(max(1, -(-queries // query_rows))), "queries").drop("block")
    every = F.sequence(F.lit(0).cast("long"), (blocks - 1).cast("long"))
    asked = asked.withColumn("block", F.explode(every))
    held = blocked(placed, key, blocks, "candidates")
    return asked.join(held.withColumn("block", F.col("block").cast("long")), [key, "block"])


def _unpacked(column: pa.ListArray, row: int):
    import numpy as np

    cells = column[row].values
    ids = cells.field(0).to_numpy(zero_copy_only=False)
    inner = cells.field(1)
    flat = inner.flatten().to_numpy(zero_copy_only=False)
    return np.asarray(ids), flat.reshape(len(ids), -1)


def _collapsed(ids, x, keep: int):
    """Distinct vectors, and for each the ``keep`` smallest ids; ``ids`` ascend."""
    import numpy as np

    raw = np.ascontiguousarray(x + 0.0).view(np.dtype((np.void, x.shape[1] * 8))).ravel()
    _, first, which = np.unique(raw, return_index=True, return_inverse=True)
    order = np.argsort(which, kind="stable")
    starts = np.r_[np.flatnonzero(np.r_[True, np.diff(which[order]) > 0]), len(ids)]
    held = [ids[order[a : min(b, a + keep)]] for a, b in zip(starts, starts[1:])]
    return x[first], held


def best_pairs(pairs: DataFrame, k: int, measure: Callable, exact: Callable, slack: float) -> DataFrame:
    """(query_id, vec_id, score) of the k best of each query in each block it meets.

    ``pairs`` holds lists ``queries`` and ``candidates``. ``measure(q, x)`` scores all
    pairs, perhaps rounded; ``exact(a, x)`` scores one query against some candidates, and
    decides among those within ``slack`` of the best k. A query never meets its own id.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            for row in range(batch.num_rows):
                names, q = _unpacked(batch.column("queries"), row)
                ids, x = _unpacked(batch.column("candidates"), row)
                x, held = _collapsed(ids, x, k + 1)
                out: list[list] = [[], [], []]
                for a in range(0, len(q), 256):
                    scores = measure(q[a : a + 256], x)
                    most = min(k + 1, len(x))
                    last = -np.partition(-scores, most - 1, axis=1)[:, most - 1]
                    for i, name in enumerate(names[a : a + 256].tolist()):
                        near = np.flatnonzero(scores[i] >= last[i] - slack)
                        values = exact(q[a + i], x[near]).tolist()
                        found = [
                            (-v, d) for v, n in zip(values, near.tolist())
                            for d in held[n].tolist() if d != name
                        ]
                        found.sort()
                        out[0] += [name] * min(k, len(found))
                        out[1] += [d for _, d in found[:k]]
                        out[2] += [-v for v, _ in found[:k]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())],
                    names=["query_id", "vec_id", "score"],
                )

    schema = "query_id long, vec_id long, score double"
    return pairs.select("queries", "candidates").mapInArrow(run, schema)


def ranked_best(found: DataFrame, k: int) -> DataFrame:
    """The k best over all blocks, with ``rank`` from 1."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
