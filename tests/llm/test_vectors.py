"""Vector searches against brute force."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from glossa.llm import learned_index, vectors, voronoi

SCHEMA = "vec_id long, embedding array<float>, label int, score string, cell string, v string"


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 16))
    made = []
    for i in range(900):
        x = centres[i % 12] + 0.4 * rng.normal(size=16)
        made.append((i, (x / np.linalg.norm(x)).astype(np.float32).tolist()))
    same = made[7][1]
    made += [(i, same) for i in range(2_000, 2_300)]  # many equal vectors
    made += [(i, [0.0] * 16) for i in (3_000, 3_020)]
    made += [(4_000, None), (4_020, [1.0, None]), (4_040, [math.nan] * 16), (4_060, [math.inf] * 16)]
    made += [(5_000, [1.0, 2.0]), (5_001, [0.5, 1.0]), (5_050, []), (None, same), (20, [9.0] * 16), (None, [8.0] * 16)]
    return [(i, v, 0, "x", "x", "x") for i, v in made]


def usable(rows, of):
    """(id, vector) of every row that takes part; ids may repeat or be null."""
    kept = []
    for i, v, *_ in rows:
        if v and all(x is not None and math.isfinite(x) for x in v):
            kept.append((i, [of(float(np.float32(c))) for c in v]))
    return kept


def by_hand(kept, step, k, score):
    """(query id, rank, score, id) of the k best of each query row, against all other rows."""
    found = []
    for at, (q, x) in enumerate(kept):
        if q is None or q % step:
            continue
        near = [
            (-score(x, y), c is None, c or 0)
            for other, (c, y) in enumerate(kept) if other != at and len(x) == len(y)
        ]
        near = sorted(near)[:k]
        found += [(q, r + 1, -s, None if none else c) for r, (s, none, c) in enumerate(near)]
    return sorted(found, key=str)


def inner(a, b):
    return int(np.dot(np.array(a), np.array(b)))


@pytest.mark.parametrize("block", [vectors.BLOCK_ROWS, 64])
def test_top_k_is_exact(spark, rows, block, monkeypatch):
    monkeypatch.setattr(voronoi, "BLOCK_ROWS", block)
    monkeypatch.setattr(voronoi, "QUERY_ROWS", 16)
    made = spark.createDataFrame(rows, SCHEMA).repartition(3)
    found = voronoi.top_k(
        made, F.col("vec_id") % 20 == 0, k=20, pivots=9,
        component=lambda x: F.floor(64 * x).cast("double"),
    )
    got = [(r["query_id"], r["rank"], int(r["score"]), r["vec_id"]) for r in found.collect()]
    assert sorted(got, key=str) == by_hand(usable(rows, lambda x: math.floor(64 * x)), 20, 20, inner)
    assert sum(q == 20 for q, *_ in got) == 40 and any(c is None for *_, c in got)


def test_top_k_of_nothing(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert voronoi.top_k(none, F.col("vec_id") % 20 == 0, k=20).count() == 0
    assert learned_index.search(none, F.col("vec_id") % 50 == 0, k=5).count() == 0


def test_learned_index_finds_most_neighbours(spark, rows):
    made = spark.createDataFrame(rows, SCHEMA).repartition(3)
    found = learned_index.search(made, F.col("vec_id") % 50 == 0, k=5).collect()
    kept = [(i, v) for i, v in usable(rows, float) if any(v)]

    def cosine(a, b):
        a, b = np.array(a), np.array(b)
        return float((a * b).sum() / (np.sqrt((a * a).sum()) * np.sqrt((b * b).sum())))

    want = by_hand(kept, 50, 5, cosine)
    got = sorted(((r["query_id"], r["rank"], r["score"], r["vec_id"]) for r in found), key=str)
    assert {q for q, *_ in got} == {q for q, *_ in want} and 5_050 not in {q for q, *_ in got}
    vectors_of = {}
    for i, v in kept:
        vectors_of.setdefault(i, []).append(v)
    for q, _, s, c in got:
        exact = [cosine(a, b) for a in vectors_of[q] for b in vectors_of[c]]
        assert min(abs(s - e) for e in exact) < 1e-12
    hits = len({(q, c) for q, _, _, c in got} & {(q, c) for q, _, _, c in want})
    assert hits >= 0.9 * len({(q, c) for q, _, _, c in want})


def test_every_length_is_searched(spark):
    rng = np.random.default_rng(6)
    made = [(i, rng.normal(size=(8, 5, 3)[(i // 3) % 3]).tolist()) for i in range(600)]
    made += [(i, [1.0, float(i)]) for i in range(600, 612)]  # too few to be cut in parts
    df = spark.createDataFrame(made, "vec_id long, embedding array<double>").repartition(3)
    found = learned_index.search(df, F.col("vec_id") % 50 == 0, k=5).collect()
    assert {r["query_id"] for r in found} == set(range(0, 601, 50))
    lengths = {i: len(v) for i, v in made}
    assert all(lengths[r["query_id"]] == lengths[r["vec_id"]] for r in found)
    assert sorted(r["rank"] for r in found if r["query_id"] == 600) == [1, 2, 3, 4, 5]


def test_parts_are_balanced():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(500, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    part = learned_index.balanced_parts(x, learned_index.neighbours(x, 10), 8)
    assert np.bincount(part, minlength=8).max() <= math.ceil(learned_index.OVER * 500 / 8)
