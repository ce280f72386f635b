"""Documents drawn by how much more likely their words are in a target text than here.

Words of a text (A to Z made small) and their runs of up to ``runs`` words are features, a
feature's bucket is the CRC-32 of its bytes by remainder. The buckets of all documents and
of the target texts are counted; the gain of a bucket is the logarithm of the ratio of its
two smoothed shares, in thousandths rounded down. A document's weight is the sum over its
features, its score adds seeded Gumbel noise, and the documents with the highest scores
are a draw without replacement in proportion to their weights.

CRCs are taken for all distinct features of a slice of text at once: features are grouped
by their length in bytes into two-dimensional arrays of uint8, the CRCs of a whole group
advance column by column through the table of 256 remainders, and the buckets are
scattered back to the features' places. Features longer than ``LONG`` bytes, of which a
group seldom has two, take zlib's CRC, which is the same number.

Texts are cut into words once; the buckets of each document are stored and read again for
the counts and the weights. Counts are summed in each task first, so at most ``buckets``
rows leave it, and as many reach the driver. Ranks come from sorted ranges, so neither the
draw nor any other step passes through one task.

Defined cases: a null, empty or wordless text has no features, weight 0 and is never drawn
where ``min_words`` is over 0; rows equal in id each get their row and, with the same
score, ranks in any order; a null id counts as the empty text in the noise and comes after
all others in ties; no target texts, or an empty table, are counts of zero; no rows give
no rows. A word of any length is one feature. Only id and text are read.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StructType

from glossa.llm.common import ranked, work
from glossa.session import WorkFolder

#: Bytes of text cut into words at once.
SLICE_BYTES = 4_000_000

#: Features of more bytes than this are not worth a matrix of their length.
LONG = 512

#: The gains are sent along with the tasks: 8 bytes each.
MOST_BUCKETS = 1_000_000

POLYNOMIAL = 0xEDB88320


def _cleaned() -> bytes:
    """For each byte of a text: itself in a word, a blank outside, A to Z small."""
    kept = {*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)}
    small = {c: c + 32 for c in range(0x41, 0x5B)}
    return bytes(small.get(c, c if c in kept else 0x20) for c in range(256))


def _remainders() -> "np.ndarray":  # noqa: F821
    import numpy as np

    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(POLYNOMIAL), table >> 1)
    return table


def crc_matrix(features: list[bytes]) -> "np.ndarray":  # noqa: F821
    """The unsigned CRC-32 of each feature, by matrices of features of equal length."""
    import numpy as np

    out = np.zeros(len(features), np.uint32)
    sizes = np.fromiter(map(len, features), np.int64, len(features))
    flat = np.frombuffer(b"".join(features), np.uint8)
    starts = np.cumsum(sizes) - sizes
    table = _remainders()
    for size in np.unique(sizes):
        rows = np.flatnonzero(sizes == size)
        if size > LONG:
            out[rows] = [zlib.crc32(features[i]) for i in rows.tolist()]
            continue
        matrix = flat[starts[rows][:, None] + np.arange(size)]
        crc = np.full(len(rows), 0xFFFFFFFF, np.uint32)
        for column in matrix.T:
            crc = table[(crc ^ column) & 0xFF] ^ (crc >> 8)
        out[rows] = ~crc
    return out


class _Features:
    """Cuts texts and puts their features in buckets."""

    def __init__(self, runs: int, buckets: int):
        self.runs, self.buckets, self.clean = runs, buckets, _cleaned()

    def cut(self, text: bytes | None) -> tuple[int, list[bytes]]:
        words = (text or b"").translate(self.clean).split()
        found = list(words)
        for n in range(2, self.runs + 1):
            found += [b" ".join(words[i : i + n]) for i in range(len(words) - n + 1)]
        return len(words), found

    def placed(self, texts: list[bytes | None]) -> tuple[list[int], "np.ndarray", "np.ndarray"]:  # noqa: F821
        """Words of each text, ends of its features, and the buckets of all features."""
        import numpy as np

        words, ends, features = [], [], []
        for text in texts:
            n, more = self.cut(text)
            words.append(n)
            features += more
            ends.append(len(features))
        distinct = list(dict.fromkeys(features))
        place = dict(zip(distinct, (crc_matrix(distinct) % self.buckets).tolist()))
        buckets = np.fromiter(map(place.__getitem__, features), np.int32, len(features))
        return words, np.array(ends, np.int64), buckets


def in_buckets(docs: DataFrame, ids: list[str], text: str, runs: int, buckets: int) -> DataFrame:
    """The columns ``ids`` with ``n_words`` and the list ``buckets`` of all features."""
    narrow = docs.select(*[F.col(c) for c in ids], F.col(text).cast("binary").alias("_bytes"))
    added = StructType.fromDDL("n_words long, buckets array<int>")
    schema = StructType([*narrow.drop("_bytes").schema, *added])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        cutter = _Features(runs, buckets)
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column("_bytes")), 0).to_numpy()
            slices = np.cumsum(sizes, dtype=np.int64) // SLICE_BYTES
            edges = [0, *(np.flatnonzero(np.diff(slices)) + 1).tolist(), batch.num_rows]
            for low, high in zip(edges, edges[1:]):
                some = batch.slice(low, high - low)
                words, ends, found = cutter.placed(some.column("_bytes").to_pylist())
                listed = pa.ListArray.from_arrays(
                    pa.array(np.r_[0, ends].astype(np.int32)), pa.array(found)
                )
                yield pa.RecordBatch.from_arrays(
                    [*some.columns[:-1], pa.array(words, pa.int64()), listed],
                    names=[*ids, "n_words", "buckets"],
                )

    return narrow.mapInArrow(run, schema)


def bucket_counts(stored: DataFrame, buckets: int) -> "np.ndarray":  # noqa: F821
    """How many features of the whole table fall in each bucket."""
    import numpy as np

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        counts = np.zeros(buckets, np.int64)
        for batch in batches:
            counts += np.bincount(batch.column("buckets").flatten().to_numpy(), minlength=buckets)
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(some), pa.array(counts[some])], names=["bucket", "n"]
        )

    each = stored.select("buckets").mapInArrow(run, "bucket long, n long")
    out = np.zeros(buckets, np.int64)
    for row in each.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[row["bucket"]] = row["n"]
    return out


def gains(here: "np.ndarray", target: "np.ndarray") -> list[int]:  # noqa: F821
    """The smoothed logarithm of the ratio of shares of each bucket, in thousandths."""
    many = len(here)
    all_here, all_target = float(here.sum()) + many, float(target.sum()) + many
    return [
        math.floor(1000 * math.log((t + 1.0) * all_here / ((s + 1.0) * all_target)))
        for s, t in zip(here.tolist(), target.tolist())
    ]


def weighed(stored: DataFrame, ids: list[str], gain: list[int]) -> DataFrame:
    """The columns ``ids`` with ``n_words``, ``n_features`` and ``weight``."""
    kept = [*ids, "n_words"]
    added = StructType.fromDDL("n_features long, weight long")
    schema = StructType([*stored.select(*kept).schema, *added])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        of = np.array(gain, np.int64)
        for batch in batches:
            lists = batch.column("buckets")
            ends = lists.offsets.to_numpy()
            total = np.r_[0, np.cumsum(of[lists.flatten().to_numpy()])]
            ends = ends - ends[0]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in kept),
                 pa.array(np.diff(ends).astype(np.int64)), pa.array(np.diff(total[ends]))],
                names=[*kept, "n_features", "weight"],
            )

    return stored.select(*kept, "buckets").mapInArrow(run, schema)


def noise(doc_id: Column, seed: int) -> Column:
    """Gumbel noise in thousandths, rounded down, by a hash of seed and id."""
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(named, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def resample(
    docs: DataFrame,
    target: DataFrame,
    *,
    runs: int = 1,
    buckets: int = 10_000,
    percent: int = 10,
    min_words: int = 20,
    seed: int = 2024,
    doc_id: str = "doc_id",
    text: str = "text",
    target_text: str = "text",
    folder: WorkFolder | None = None,
) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank) of every row of ``docs``.

    Of the N documents with ``min_words`` words or more, the N * percent // 100 with the
    highest scores have a ``rank``, from 1; for all others it is null.
    """
    if not 0 < buckets <= MOST_BUCKETS:
        raise ValueError(f"buckets must be 1 to {MOST_BUCKETS}")
    folder = folder or work(docs.sparkSession)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    here = folder.write(in_buckets(rows, ["doc_id"], "text", runs, buckets), "buckets")
    there = target.select(F.col(target_text).alias("text"))
    there = folder.write(in_buckets(there, [], "text", runs, buckets), "target")
    gain = gains(bucket_counts(here, buckets), bucket_counts(there, buckets))
    scored = weighed(here, ["doc_id"], gain)
    scored = scored.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    scored = folder.write(scored.withColumn("_tie", F.monotonically_increasing_id()), "scores")
    able = scored.filter(F.col("n_words") >= min_words)
    most = able.count() * percent // 100
    able = able.withColumns({"_down": -F.col("score"), "_none": F.col("doc_id").isNull()})
    able = ranked(able, ["_down", "_none", "doc_id", "_tie"], folder, "ranked")
    names = ["doc_id", "n_words", "n_features", "weight", "score"]
    place = F.when(F.col("rank") < most, F.col("rank") + 1)
    others = scored.filter(F.col("n_words") < min_words)
    return able.select(*names, place.alias("rank")).union(
        others.select(*names, F.lit(None).cast("long").alias("rank"))
    )


def drawn(docs: DataFrame, ranks: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """The documents that have a rank; rows equal in id are drawn together."""
    ids = ranks.filter(F.col("rank").isNotNull()).select(F.col("doc_id").alias("_drawn")).distinct()
    return docs.join(ids, docs[doc_id].eqNullSafe(ids["_drawn"]), "left_semi")
