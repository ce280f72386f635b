"""Vectors whitened along the leading components of their covariance.

Each distinct vector counts once. Sums over them are exact whole numbers; the covariance is
taken of vectors less their mean: a whole number is taken off exactly, the fraction that is
left after it. Tasks add up their rows, and the sums of all tasks meet row by row of the
matrix, so no task holds more than its share of it and the driver gets one matrix for each
length of vector. Its leading eigenvalues and vectors come from ``spectrum``: counts by
L D Lᵀ of the shifted covariance isolate each, Rayleigh quotient iteration finds it, and
counts certify its number. A second pass over the distinct vectors measures how far the
covariance of the whitened ones is from the identity.

Defined cases: a vector that is null, or holds a null, an entry that is not finite or one
that is no whole number below 2^52 after ``component``, takes no part; vectors of each
length are a table of their own; a null id, and rows equal in id, each get their rows;
components with no variance (a single vector, fewer vectors than entries) are left out, so
such rows have fewer components, or none; a vector without entries has no rows; a deviation
beyond a long is null; no rows give no rows. Only id and vector are read.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StructType

from glossa.llm.common import work
from glossa.llm.spectrum import leading
from glossa.llm.vectors import matrices
from glossa.session import WorkFolder

#: Rows of a matrix product at once.
ROWS = 8_192


@dataclass(frozen=True)
class Whitening:
    """What a table of vectors of one length was fit to."""

    n: int
    sums: list[int]
    values: "np.ndarray"  # noqa: F821
    vectors: "np.ndarray"  # noqa: F821
    trace: float
    error: float = 0.0

    def centred(self, x: "np.ndarray") -> "np.ndarray":  # noqa: F821
        """Whole rows less the mean."""
        import numpy as np

        whole = [s // self.n for s in self.sums]
        part = [(s - w * self.n) / self.n for s, w in zip(self.sums, whole)]
        return (x - np.array(whole, np.int64)).astype(float) - np.array(part)

    def projected(self, x: "np.ndarray") -> "np.ndarray":  # noqa: F821
        import numpy as np

        return self.centred(x) @ (self.vectors / np.sqrt(self.values))

    def deviations(self, x: "np.ndarray") -> list[int | None]:  # noqa: F821
        """The sum of (n x - S)^2 of each row, exactly; None if it is no long."""
        import numpy as np

        near = (self.centred(x) * self.n) ** 2
        small = near.sum(axis=1) < 2.0**62
        out: list[int | None] = [None] * len(x)
        if small.any():
            whole = [s // self.n for s in self.sums]
            off = np.array([s - w * self.n for s, w in zip(self.sums, whole)], np.int64)
            d = self.n * (x[small] - np.array(whole, np.int64)) - off
            for i, value in zip(np.flatnonzero(small).tolist(), (d * d).sum(axis=1).tolist()):
                out[i] = value
        for i in np.flatnonzero(~small).tolist():
            exact = sum((self.n * v - s) ** 2 for v, s in zip(x[i].tolist(), self.sums))
            out[i] = exact if exact < 2**63 else None
        return out


def usable(df: DataFrame, vec_id: str, vector: str, component: Callable[[Column], Column]) -> DataFrame:
    """(vec_id, v): vectors of one whole number or more, as longs."""
    rows = df.select(F.col(vec_id).alias("vec_id"), F.col(vector).alias("v"))
    rows = rows.filter(F.size("v") > 0)
    rows = rows.withColumn("v", F.transform("v", lambda c: component(c.cast("double"))))
    good = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < 2.0**52))
    return rows.filter(good).withColumn("v", F.transform("v", lambda c: c.cast("long")))


def _added(rows: DataFrame, of: Callable[["np.ndarray"], "np.ndarray"]) -> dict[int, "np.ndarray"]:  # noqa: F821
    """By length of vector, the sum over all rows of the matrices ``of`` gives for some."""
    schema = "dim int, at int, n long, line array<double>"

    def emitted(sums: dict) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for (dim, at), (n, line) in sums.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([dim], pa.int32()), pa.array([at], pa.int32()), pa.array([n], pa.int64()),
                 pa.ListArray.from_arrays(pa.array([0, len(line)], pa.int32()), pa.array(np.asarray(line, float)))],
                names=["dim", "at", "n", "line"],
            )

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list] = {}
        for batch in batches:
            for _, _, x in matrices(batch.column("vec_id"), batch.column("v")):
                for low in range(0, len(x), ROWS):
                    more = of(x[low : low + ROWS])
                    held = sums.setdefault(x.shape[1], [0, 0.0])
                    held[0] += len(x[low : low + ROWS])
                    held[1] = held[1] + more
        for dim, (n, matrix) in sums.items():
            yield from emitted({(dim, at): (n, line) for at, line in enumerate(matrix)})

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict = defaultdict(lambda: [0, 0.0])
        for batch in batches:
            lines = batch.column("line")
            for i, (dim, at, n) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("dim", "at", "n")))):
                held = sums[dim, at]
                held[0] += n
                held[1] = held[1] + lines[i].values.to_numpy()
        yield from emitted(sums)

    parts = rows.mapInArrow(local, schema).repartition("dim", "at").mapInArrow(met, schema)
    found: dict[int, dict] = defaultdict(dict)
    for row in parts.collect():  # one matrix for each length of vector
        found[row["dim"]][row["at"]] = row["line"]
    return {dim: _stacked(lines) for dim, lines in found.items()}


def _stacked(lines: dict[int, list[float]]) -> "np.ndarray":  # noqa: F821
    import numpy as np

    return np.array([lines[at] for at in sorted(lines)], float)


def _sums(rows: DataFrame) -> dict[int, tuple[int, list[int]]]:
    """(n, sums of the entries) by length of vector, exactly, in two halves of 26 bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        sums: dict[int, list] = {}
        for batch in batches:
            for _, _, x in matrices(batch.column("vec_id"), batch.column("v")):
                high = x >> 26
                held = sums.setdefault(x.shape[1], [0, 0, 0])
                held[0] += len(x)
                held[1] = held[1] + high.sum(axis=0)
                held[2] = held[2] + (x - (high << 26)).sum(axis=0)
        for dim, (n, high, low) in sums.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(dim, dim, np.int32)), pa.array(np.arange(dim, dtype=np.int32)),
                 pa.array(np.full(dim, n, np.int64)), pa.array(high), pa.array(low)],
                names=["dim", "at", "n", "high", "low"],
            )

    each = rows.mapInArrow(run, "dim int, at int, n long, high long, low long")
    total = each.groupBy("dim", "at").agg(F.sum("n").alias("n"), F.sum("high").alias("high"), F.sum("low").alias("low"))
    found: dict[int, tuple[int, list[int]]] = {}
    for r in sorted(total.collect(), key=lambda r: (r["dim"], r["at"])):
        found.setdefault(r["dim"], (r["n"], []))[1].append((r["high"] << 26) + r["low"])
    return found


def fit(rows: DataFrame, components: int, folder: WorkFolder) -> dict[int, Whitening]:
    """A whitening for each length among the distinct vectors of ``rows``."""
    once = folder.write(rows.select("v").distinct(), "distinct")
    once = once.select(F.lit(0).cast("long").alias("vec_id"), "v")
    import numpy as np

    empty = (np.zeros(0), np.zeros((0, 0)), 0.0)
    made = {dim: Whitening(n, sums, *empty) for dim, (n, sums) in _sums(once).items()}

    def products(x: np.ndarray) -> np.ndarray:
        y = made[x.shape[1]].centred(x)
        return y.T @ y

    for dim, total in _added(once, products).items():
        covariance = total / made[dim].n
        values, vectors = leading(covariance, components)
        made[dim] = Whitening(
            made[dim].n, made[dim].sums, values, vectors, float(np.trace(covariance))
        )

    def white(x: np.ndarray) -> np.ndarray:
        y = made[x.shape[1]].projected(x)
        return y.T @ y

    for dim, total in _added(once, white).items():
        k = len(made[dim].values)
        error = float(np.abs(total / made[dim].n - np.eye(k)).max()) if k else 0.0
        old = made[dim]
        made[dim] = Whitening(old.n, old.sums, old.values, old.vectors, old.trace, error)
    return made


def whiten(
    df: DataFrame,
    *,
    components: int = 16,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    component: Callable[[Column], Column],
    folder: WorkFolder | None = None,
) -> DataFrame:
    """A row for each vector and component, numbered from 1 by falling variance.

    ``component`` makes a whole number of an entry, as a double. ``n`` is the number of
    distinct vectors, ``deviation`` the sum of (n x - S)^2 with the sums S, ``whitened``
    the place along the component in units of its deviation, ``explained`` its share of
    the variance, ``identity_error`` the largest entry by which the covariance of the
    whitened vectors is not the identity.
    """
    folder = folder or work(df.sparkSession)
    rows = folder.write(usable(df, vec_id, vector, component), "vectors")
    made = fit(rows, components, folder)
    added = StructType.fromDDL(
        "component int, n long, deviation long, whitened double, explained double, identity_error double"
    )
    schema = StructType([*rows.select("vec_id").schema, *added])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            for at, _, x in matrices(batch.column("vec_id"), batch.column("v")):
                how = made.get(x.shape[1])
                k = len(how.values) if how else 0
                if not k:
                    continue
                ids = batch.column("vec_id").take(pa.array(np.repeat(at, k)))
                deviation = [d for d in how.deviations(x) for _ in range(k)]
                share = how.values / how.trace
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                     pa.array(np.full(k * len(x), how.n, np.int64)), pa.array(deviation, pa.int64()),
                     pa.array(how.projected(x).ravel()), pa.array(np.tile(share, len(x))),
                     pa.array(np.full(k * len(x), how.error))],
                    names=schema.names,
                )

    return rows.mapInArrow(run, schema)
