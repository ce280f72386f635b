"""Exact top-k by inner product: a Voronoi kNN join.

Pivots, a bounded sample, cut the space in cells: every vector belongs to its nearest
pivot. A summary of each cell has the number of its vectors, its radius and its largest
norm; for a query q and a cell with pivot c and radius r all inner products lie between
q.c - |q| r and q.c + |q| r, and below |q| times the largest norm. The cells with the
largest lower bounds that hold k vectors besides the query give a score that k candidates
reach; only cells whose upper bound reaches it as well can matter, and the query is
replicated to those. Queries and vectors meet there in blocks.

The summaries have one row for each pivot, and one for each length of vectors.

Defined cases: vectors that are null, empty or hold null or non-finite components take no
part; vectors of different lengths are not compared; rows equal in vec_id are candidates
and queries each, and only its own row is no candidate of a query; a null vec_id is a
candidate like any other; ties go to the smaller vec_id, null last; fewer candidates than
k give all of them; no rows give no rows; further columns are not kept.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from glossa.llm.common import work
from glossa.llm.vectors import (
    BLOCK_ROWS, QUERY_ROWS, best_pairs, meetings, named, per_row, ranked_best, usable,
)

#: Pivots are rows with the smallest hashes of their ids: half the square root of the
#: number of rows, between these. The summaries of their cells are on the driver.
PIVOTS = 64
MOST_PIVOTS = 1_024


def _inner(q, x):
    """Inner products; exact for integers while the sums stay below 2^53."""
    return q @ x.T


def _inner_one(a, x):
    return (x * a).sum(axis=1)


def top_k(
    rows: DataFrame,
    is_query: Column,
    *,
    k: int,
    pivots: int | None = None,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    component: Callable[[Column], Column] = lambda x: x,
) -> DataFrame:
    """(query_id, rank, vec_id, score) for rows where ``is_query``, an expression of vec_id."""
    import numpy as np

    folder = work(rows.sparkSession)
    stored = usable(rows, vec_id, vector, component, folder)
    kept = stored.select("vec_id", "v")
    if pivots is None:
        pivots = min(max(PIVOTS, math.isqrt(kept.count()) // 2), MOST_PIVOTS)
    sample = kept.orderBy(F.xxhash64("vec_id"), "vec_id").limit(pivots).collect()
    centres: dict[int, list] = {}
    for r in sample:
        centres.setdefault(len(r["v"]), []).append(r["v"])
    by_size = {d: np.unique(np.array([[0.0] * d, *vs]), axis=0) for d, vs in centres.items()}
    most = pivots + 1

    def cells(dim: int) -> "np.ndarray":  # noqa: F821
        """The pivots of a length; the origin alone where the sample has none."""
        return by_size.get(dim, np.zeros((1, dim)))

    def assigned(ids, x):
        c = cells(x.shape[1])
        square = (x**2).sum(1)
        far = square[:, None] - 2 * (x @ c.T) + (c**2).sum(1)
        near = far.argmin(1)
        gap = np.sqrt(((x - c[near]) ** 2).sum(1))
        return {"cell": x.shape[1] * most + near, "gap": gap, "norm": np.sqrt(square)}

    placed = per_row(kept, assigned, {"cell": "long", "gap": "double", "norm": "double"})
    placed = folder.write(placed, "placed")
    summary = {
        r["cell"]: (r["n"], r["radius"], r["norm"])
        for r in placed.groupBy("cell")
        .agg(F.count("*").alias("n"), F.max("gap").alias("radius"), F.max("norm").alias("norm"))
        .collect()
    }

    def needed(ids, x):
        dim = x.shape[1]
        names = [c for c in sorted(summary) if c // most == dim]
        c = cells(dim)[[n % most for n in names]]
        count, radius, norm = (np.array(v) for v in zip(*[summary[n] for n in names]))
        length = np.sqrt((x**2).sum(1))[:, None]
        middle = x @ c.T
        spare = 1e-9 * (1 + length * (norm + radius + np.sqrt((c**2).sum(1))))
        low = middle - length * radius - spare
        high = np.minimum(middle + length * radius, length * norm) + spare
        order = np.argsort(-low, axis=1)
        # The query itself may be among the vectors that are counted.
        enough = np.cumsum(count[order], axis=1) >= k + 1
        last = np.where(enough.any(1), enough.argmax(1), len(names) - 1)
        bound = np.take_along_axis(low, np.take_along_axis(order, last[:, None], 1), 1)
        bound[~enough.any(1)] = -np.inf
        wanted = high >= bound
        return {"cells": [[names[j] for j in np.flatnonzero(w)] for w in wanted]}

    asked = stored.withColumnsRenamed({"vec_id": "_row", "name": vec_id}).filter(is_query)
    asked = asked.select(F.col("_row").alias("vec_id"), "v")
    routed = per_row(asked, needed, {"cells": "array<bigint>"})
    routed = routed.select(F.explode("cells").alias("cell"), "vec_id", "v")
    counts = {c: n for c, (n, _, _) in summary.items()}
    pairs = meetings(routed, asked.count(), placed, counts, "cell", BLOCK_ROWS, QUERY_ROWS)
    found = best_pairs(pairs, k, _inner, _inner_one, 0.0)
    return named(ranked_best(found, k), stored)
