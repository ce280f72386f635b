"""Approximate nearest neighbours by learned partitions.

On a bounded sample: the graph of each vector's nearest neighbours is cut into balanced
parts, starting from median cuts along main directions and then moving vectors to the part
that has most of their neighbours while no part grows over its bound. A small network
learns, from a vector alone, in which parts its neighbours lie. Every row is indexed under
its likeliest part; a query goes to the ``probes`` likeliest, and what they hold is
reranked by the exact cosine.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components
take no part; vectors of different lengths are not compared, each length in the sample has
a partition and network of its own, and a length it hardly has is one part that is searched
whole; rows equal in vec_id are candidates and queries each, and only its own row is no
candidate of a query; a null vec_id is a candidate like any other; ties go to the smaller
vec_id, null last; fewer candidates than k give all that are found; no rows give no rows;
further columns are not kept.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from glossa.llm.common import work
from glossa.llm.vectors import (
    BLOCK_ROWS, QUERY_ROWS, best_pairs, meetings, named, per_row, ranked_best, usable,
)

#: The most rows the partition is learned on.
SAMPLE_ROWS = 6_000
#: A length with fewer vectors in the sample is not cut in parts.
LEAST_VECTORS = 50
PARTS = 16
PROBES = 12
NEIGHBOURS = 10
OVER = 1.1
SWEEPS = 12
HIDDEN = 96
EPOCHS = 30
SEED = 11


class Router(NamedTuple):
    dim: int
    layers: tuple

    def scores(self, x):
        import numpy as np

        w, b, v, c = self.layers
        unit = x / np.sqrt((x**2).sum(1, keepdims=True))
        return np.maximum(unit @ w + b, 0) @ v + c


def neighbours(x, k: int):
    """The k nearest by cosine of each row of a matrix of unit vectors."""
    import numpy as np

    k = min(k, len(x) - 1)
    found = np.zeros((len(x), max(k, 0)), np.int64)
    for a in range(0, len(x), 512):
        near = x[a : a + 512] @ x.T
        near[np.arange(len(near)), np.arange(a, a + len(near))] = -np.inf
        if k > 0:
            found[a : a + 512] = np.argpartition(-near, k - 1, axis=1)[:, :k]
    return found


def balanced_parts(x, graph, parts: int):
    """A part for each row: parts of nearly one size that cut few edges of the graph."""
    import numpy as np

    part = np.zeros(len(x), np.int64)
    groups = [np.arange(len(x))]
    while len(groups) < parts:
        group = max(groups, key=len)
        groups = [g for g in groups if g is not group]
        body = x[group] - x[group].mean(0)
        axis = np.linalg.eigh(body.T @ body)[1][:, -1]
        order = group[np.argsort(body @ axis, kind="stable")]
        groups += [order[: len(order) // 2], order[len(order) // 2 :]]
    for i, group in enumerate(groups):
        part[group] = i
    most = int(np.ceil(OVER * len(x) / parts))
    rows = np.repeat(np.arange(len(x)), graph.shape[1])
    for _ in range(SWEEPS):
        votes = np.zeros((len(x), parts))
        np.add.at(votes, (rows, part[graph.ravel()]), 1)
        np.add.at(votes, (graph.ravel(), part[rows]), 1)
        to = votes.argmax(1)
        gain = votes[np.arange(len(x)), to] - votes[np.arange(len(x)), part]
        size = np.bincount(part, minlength=parts)
        moved = 0
        for i in np.argsort(-gain, kind="stable"):
            if gain[i] <= 0:
                break
            if size[to[i]] < most:
                size[part[i]] -= 1
                size[to[i]] += 1
                part[i] = to[i]
                moved += 1
        if not moved:
            break
    return part


def fit_router(x, parts: int) -> Router:
    """Cut the graph of unit vectors and learn where the neighbours of a vector lie."""
    import numpy as np

    rng = np.random.default_rng(SEED)
    graph = neighbours(x, NEIGHBOURS)
    parts = max(1, min(parts, len(x)))
    part = balanced_parts(x, graph, parts)
    target = np.zeros((len(x), parts))
    target[np.arange(len(x)), part] = 1
    if graph.shape[1]:
        rows = np.repeat(np.arange(len(x)), graph.shape[1])
        np.add.at(target, (rows, part[graph.ravel()]), 1)
    target /= target.sum(1, keepdims=True)
    dim = x.shape[1]
    w = [
        rng.normal(0, (2 / dim) ** 0.5, (dim, HIDDEN)), np.zeros(HIDDEN),
        rng.normal(0, HIDDEN**-0.5, (HIDDEN, parts)), np.zeros(parts),
    ]
    first, second = [np.zeros_like(a) for a in w], [np.zeros_like(a) for a in w]
    step = 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(x))
        for a in range(0, len(x), 128):
            rows = order[a : a + 128]
            inner = x[rows] @ w[0] + w[1]
            hidden = np.maximum(inner, 0)
            out = hidden @ w[2] + w[3]
            p = np.exp(out - out.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            error = (p - target[rows]) / len(rows)
            back = (error @ w[2].T) * (inner > 0)
            grads = [x[rows].T @ back, back.sum(0), hidden.T @ error, error.sum(0)]
            step += 1
            for j, g in enumerate(grads):
                first[j] = 0.9 * first[j] + 0.1 * g
                second[j] = 0.999 * second[j] + 0.001 * g * g
                w[j] = w[j] - 3e-3 * (first[j] / (1 - 0.9**step)) / (
                    np.sqrt(second[j] / (1 - 0.999**step)) + 1e-8
                )
    return Router(dim, tuple(w))


def _cosines(q, x):
    import numpy as np

    return (q / np.sqrt((q**2).sum(1))[:, None]) @ (x / np.sqrt((x**2).sum(1))[:, None]).T


def _cosine_one(a, x):
    import numpy as np

    return (x * a).sum(axis=1) / (np.sqrt((a * a).sum()) * np.sqrt((x * x).sum(axis=1)))


def search(
    rows: DataFrame,
    is_query: Column,
    *,
    k: int,
    parts: int = PARTS,
    probes: int = PROBES,
    sample_rows: int = SAMPLE_ROWS,
    vec_id: str = "vec_id",
    vector: str = "embedding",
) -> DataFrame:
    """(query_id, rank, vec_id, score) for rows where ``is_query``, an expression of vec_id."""
    import numpy as np

    folder = work(rows.sparkSession)
    stored = usable(rows, vec_id, vector, lambda x: x, folder)
    stored = stored.filter(F.exists("v", lambda x: x != 0))
    kept = stored.select("vec_id", "v")
    sample = kept.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample_rows).collect()
    by_dim: dict[int, list] = {}
    for r in sample:
        by_dim.setdefault(len(r["v"]), []).append(r["v"])
    routers = {}
    for dim, vectors in by_dim.items():
        if len(vectors) < LEAST_VECTORS:
            continue
        x = np.array(vectors)
        routers[dim] = fit_router(x / np.sqrt((x**2).sum(1, keepdims=True)), parts)

    def scores(x):
        """Of the parts; a length that the sample hardly has is one part, searched exactly."""
        router = routers.get(x.shape[1])
        return router.scores(x) if router else np.zeros((len(x), 1))

    def indexed(ids, x):
        return {"part": x.shape[1] * parts + scores(x).argmax(1)}

    def routed(ids, x):
        order = np.argsort(-scores(x), axis=1, kind="stable")
        return {"parts": list(x.shape[1] * parts + order[:, :probes])}

    placed = folder.write(per_row(kept, indexed, {"part": "long"}), "placed")
    counts = {r["part"]: r["count"] for r in placed.groupBy("part").count().collect()}
    asked = stored.withColumnsRenamed({"vec_id": "_row", "name": vec_id}).filter(is_query)
    asked = asked.select(F.col("_row").alias("vec_id"), "v")
    sent = per_row(asked, routed, {"parts": "array<bigint>"})
    sent = sent.select(F.explode("parts").alias("part"), "vec_id", "v")
    pairs = meetings(sent, asked.count(), placed, counts, "part", BLOCK_ROWS, QUERY_ROWS)
    found = best_pairs(pairs, k, _cosines, _cosine_one, 1e-9)
    return named(ranked_best(found, k), stored)
