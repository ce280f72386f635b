"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Fingerprint: words in lower case (A to Z only) make shingles, the XXH64 of each shingle
votes, and a bit is set if it is set in over half of the hashes.

Search: two fingerprints within ``2 r`` bits share a variant if each emits all variants
within r bits, that is half the radius. A radius of 3 is odd, so one differing bit has to
be hidden: the 64 bits are cut in three groups, and each fingerprint emits, once for each
hidden group, all variants within one bit of what is left. Of three differing bits at
least one lies in some group; with that group hidden two at most are left, and the balls
meet. Variants are shuffled, and fingerprints with a variant in common are compared bit
by bit, so the links are exactly those within the radius.

Only distinct fingerprints take part, each with its smallest doc_id, so copies cost
nothing. Few fingerprints under one variant are compared in pairs; many are searched from
the smallest on, each step against those not reached yet, and leave their task as links to
the one that reached them: never all pairs.

Defined cases: a null, empty or blank text has fingerprint zero and is linked like any
other; with fewer words than a shingle the whole sequence is the only shingle; repeated
rows and rows equal in doc_id each get their row; a null doc_id counts as larger than
all others; no rows give no rows. Further columns pass through, but for those named like
the ones added.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from glossa.llm.common import work
from glossa.llm.components import components
from glossa.session import WorkFolder

SEED = 42
RADIUS = 3

#: The groups of bits hidden in turn.
GROUPS = ((0, 21), (21, 42), (42, 64))

#: Hashes whose votes are counted at once.
VOTES = 200_000

#: Up to so many fingerprints under one variant are compared in pairs.
PAIRED = 16

ADDED = ("fingerprint", "component_id")


def fingerprints(
    texts: list[str | None], size: int, seeds: tuple[int, ...] = (SEED,)
) -> tuple["np.ndarray", "np.ndarray"]:  # noqa: F821
    """For each text 64 bits by each seed, unsigned, and the number of its shingles."""
    import numpy as np
    import xxhash

    digest = xxhash.xxh64_intdigest
    found: list[np.ndarray] = []
    lengths: list[int] = []
    hashes: list[int] = []
    counted = 0

    def count() -> None:
        n = np.array(lengths[counted:])
        out = np.zeros((len(n), len(seeds), 64), bool)
        some = n > 0
        if some.any():
            starts = (np.cumsum(n) - n)[some]
            packed = np.array(hashes, np.uint64).astype(">u8").view(np.uint8)
            bits = np.unpackbits(packed.reshape(-1, 8 * len(seeds)), axis=1)
            votes = np.add.reduceat(bits, starts, axis=0, dtype=np.int32)
            out[some] = (2 * votes > n[some, None]).reshape(-1, len(seeds), 64)
        found.append(np.packbits(out, axis=2).view(">u8")[:, :, 0].astype(np.uint64))
        hashes.clear()

    for text in texts:
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()
        joined = b" ".join(words)
        ends, at = [], -1
        for w in words:
            at += 1 + len(w)
            ends.append(at)
        if len(words) <= size:
            parts = [joined] if words else []
        else:
            starts = [0, *(e + 1 for e in ends)]
            parts = [joined[a:b] for a, b in zip(starts, ends[size - 1 :])]
        hashes += [digest(part, seed) for part in parts for seed in seeds]
        lengths.append(len(parts))
        if len(hashes) > VOTES:
            count()
            counted = len(lengths)
    if counted < len(lengths):
        count()
    return np.concatenate(found) if found else np.zeros((0, len(seeds)), np.uint64), np.array(lengths, np.int64)


def with_fingerprint(
    docs: DataFrame, text: str, size: int, seeds: tuple[int, ...] = (SEED,)
) -> DataFrame:
    """``docs`` with the text replaced by signed longs ``_fp``, ``_fp1``, ... for the seeds,
    and by the number of shingles, ``_n``."""
    names = [c for c in docs.columns if c != text]
    made = [f"_fp{i or ''}" for i in range(len(seeds))]
    schema = docs.select(*names).schema
    for name in (*made, "_n"):
        schema = schema.add(name, "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            bits, n = fingerprints(batch.column(text).to_pylist(), size, seeds)
            columns = [batch.column(c) for c in names]
            words = [pa.array(np.ascontiguousarray(w).view(np.int64)) for w in bits.T]
            yield pa.RecordBatch.from_arrays(
                [*columns, *words, pa.array(n)], names=[*names, *made, "_n"]
            )

    return docs.select(*names, text).mapInArrow(run, schema)


def variants(distinct: DataFrame) -> DataFrame:
    """(variant, _fp): the ball of radius one in the kept bits, for each hidden group.

    The place of the hidden bits holds a mark of the group.
    """
    full = (1 << 64) - 1

    def signed(x: int) -> int:
        return x - (1 << 64) if x >> 63 else x

    masks = []
    for number, (low, high) in enumerate(GROUPS):
        hidden = ((1 << (high - low)) - 1) << low
        mark = (number + 1) << low
        flips = [0, *(1 << b for b in range(64) if not low <= b < high)]
        masks.append((signed(full & ~hidden), [signed(mark ^ f) for f in flips]))

    def ball(keep: int, flips: list[int]) -> Column:
        centre = F.col("_fp").bitwiseAND(F.lit(keep))
        return F.transform(F.array(*[F.lit(f) for f in flips]), lambda f: centre.bitwiseXOR(f))

    each = [ball(keep, flips) for keep, flips in masks]
    return distinct.select(F.explode(F.concat(*each)).alias("variant"), "_fp")


def _far(a, b):
    """Differing bits of rows of words."""
    import numpy as np

    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64)


def _searched(words, radius: int) -> Iterator[tuple[int, int]]:
    """(row, row that reached it) for all that are connected, from each lowest row on."""
    import numpy as np

    left = np.arange(len(words))
    while len(left) > 1:
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            at = queue.pop()
            near = _far(words[left], words[at]) <= radius
            reached = left[near].tolist()
            yield from ((row, at) for row in reached)
            queue += reached
            left = left[~near]


def _close(keys, words, radius: int):
    """(a, b): first words of rows with equal keys that are connected within the radius."""
    import numpy as np

    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    sizes = np.diff(np.r_[starts, len(keys)])
    small = np.repeat(sizes <= PAIRED, sizes)
    found = []
    for off in range(1, min(PAIRED, int(sizes.max()))):
        both = np.flatnonzero((keys[off:] == keys[:-off]) & small[:-off])
        near = both[_far(words[both], words[both + off]) <= radius]
        found.append(np.stack([words[near, 0], words[near + off, 0]]))
    for a, n in zip(starts[sizes > PAIRED].tolist(), sizes[sizes > PAIRED].tolist()):
        group = np.unique(words[a : a + n], axis=0)
        rows = list(_searched(group, radius))
        if rows:
            found.append(np.stack([group[[r for r, _ in rows], 0], group[[r for _, r in rows], 0]]))
    pairs = np.concatenate(found, axis=1) if found else np.zeros((2, 0), np.uint64)
    return np.unique(pairs[:, pairs[0] != pairs[1]], axis=1)


def _met(placed: DataFrame, names: list[str], radius: int) -> DataFrame:
    """(a, b) from rows (variant, words ...) that are sorted by variant in each partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        keys, words = np.zeros(0, np.int64), np.zeros((0, len(names)), np.uint64)
        seen = np.zeros((2, 0), np.uint64)
        for batch in batches:
            more = [batch.column(c).to_numpy().view(np.uint64) for c in names]
            keys = np.concatenate([keys, batch.column("variant").to_numpy()])
            words = np.concatenate([words, np.stack(more, 1)])
            last = np.searchsorted(keys, keys[-1])  # the last variant may go on
            if last:
                yield fresh(_close(keys[:last], words[:last], radius))
                keys, words = keys[last:], words[last:]
        if len(keys):
            yield fresh(_close(keys, words, radius))

    def fresh(pairs) -> pa.RecordBatch:
        import numpy as np

        return pa.RecordBatch.from_arrays(
            [pa.array(np.ascontiguousarray(p).view(np.int64)) for p in pairs], names=["a", "b"]
        )

    return placed.mapInArrow(run, "a long, b long").distinct()


def links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b): links that connect all fingerprints ``_fp`` within the radius, and no others."""
    if not 0 <= radius <= 3:
        raise ValueError("the hidden groups are made for a radius of at most 3")
    placed = variants(distinct).repartition("variant").sortWithinPartitions("variant")
    return _met(placed, ["_fp"], radius)


def _labelled(
    kept: DataFrame, distinct: DataFrame, found: DataFrame, folder: WorkFolder
) -> DataFrame:
    """Rows with the smallest doc_id that the links lead to."""
    found = folder.write(found, "links")
    roots = components(found, folder)
    joined = distinct.join(roots, distinct["_fp"] == roots["node"], "left")
    joined = joined.withColumn("_root", F.coalesce("root", "_fp"))
    lowest = joined.groupBy("_root").agg(F.min("_first").alias("component_id"))
    labels = folder.write(joined.join(lowest, "_root").select("_fp", "component_id"), "labels")
    return kept.join(labels, "_fp").select(
        "doc_id", F.lower(F.lpad(F.hex("_fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def near_duplicates(
    docs: DataFrame,
    *,
    shingle: int = 3,
    radius: int = RADIUS,
    doc_id: str = "doc_id",
    text: str = "text",
    folder: WorkFolder | None = None,
) -> DataFrame:
    """(doc_id, fingerprint, component_id), one row for each row of ``docs``."""
    folder = folder or work(docs.sparkSession)
    narrow = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kept = folder.write(with_fingerprint(narrow, "text", shingle), "fingerprints")
    distinct = kept.groupBy("_fp").agg(F.min("doc_id").alias("_first"))
    distinct = folder.write(distinct, "distinct")
    return _labelled(kept, distinct, links(distinct.select("_fp"), radius), folder)
