"""Repeated passages by relative Lempel-Ziv parsing.

The corpus is its own reference. It is cut in blocks of documents, every block indexes
its windows of ``window`` consecutive words, and the indexes are merged: for each window
the smallest document it starts in, and the place there, is its reference. Each document
is then parsed: every window is looked up, and windows that follow each other here and in
their reference are one factor. This is not the greedy parse, which follows one reference
while its words agree: that misses windows whose smaller document is another one, and would
need the reference's text in every task. Factors into documents with a smaller id are the
duplicate spans. All windows are judged on the input.

Work in three passes over stored blocks, so that little is shuffled:

1. Of each window only its anchor is sent, the run of five words with the smallest hash,
   which neighbouring windows share. Equal windows have equal anchors, so windows whose
   anchor is in one document only are done.
2. The other windows are sent as hashes of 96 bits, each once for a block, with its
   smallest document and place; blocks are told about references in other blocks.
3. Blocks parse their documents.

Blocks are rows of a bucketed table: their texts are not shuffled when answers come in.
What many documents of a block have in common is sent once for the block, so a passage
that a third of all rows hold stays a small part of any task.

Defined cases: null, empty and blank texts have no words and keep none; documents with
fewer words than a window lose none; rows equal in doc_id count as the same document;
a null doc_id counts as larger than all others; no rows give no rows; further columns of
the input are not kept.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from glossa.llm.common import work

#: Bytes of text in a block; a longer document is a block of its own.
BLOCK_BYTES = 4_000_000

#: Bytes of text for each group in which indexes are merged, and for each bucket.
GROUP_BYTES = 3_000_000
BUCKET_BYTES = 24_000_000

#: Spark's own bound; a task streams the blocks of its bucket, so buckets may be larger.
MOST_BUCKETS = 100_000

ANCHOR_WORDS = 5
NO_DOC = (1 << 63) - 1

#: What is known of a window: its hashes, a document and the place there.
ENTRY = {"key": "<u8", "chk": "<u4", "doc": "<i8", "at": "<u4"}

BLOCK = "block long, owners binary, nulls binary, sizes binary, texts binary"


def _pack(owners: list[int | None], texts: list[bytes]) -> list[bytes]:
    import numpy as np
    import zstandard

    return [
        np.array([NO_DOC if o is None else o for o in owners], "<i8").tobytes(),
        bytes(o is None for o in owners),
        np.array([len(t) for t in texts], "<i8").tobytes(),
        zstandard.ZstdCompressor(level=1).compress(b"".join(texts)),
    ]


class Block:
    """The documents of a block, their words and the hashes of their windows."""

    def __init__(self, owners: bytes, nulls: bytes, sizes: bytes, texts: bytes, window: int):
        import numpy as np
        import xxhash
        import zstandard

        data = zstandard.ZstdDecompressor().decompress(texts)
        self.window = window
        self.owners = np.frombuffer(owners, "<i8")
        self.nulls = nulls
        ends = np.cumsum(np.frombuffer(sizes, "<i8")).tolist()
        self.words: list[list[bytes]] = [
            data[a:b].split() for a, b in zip([0, *ends], ends)
        ]
        self.counts = np.array([len(w) for w in self.words], np.int64)
        self.starts = np.cumsum(self.counts) - self.counts
        flat = [w for words in self.words for w in words]
        self.hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, flat), np.uint64, len(flat))
        n = max(0, len(flat) - window + 1)
        row = np.repeat(np.arange(len(self.words)), self.counts)
        self.place = np.flatnonzero(row[:n] == row[window - 1 :][:n])
        self.row = row[self.place]
        self.doc = self.owners[self.row]

    def _runs(self, length: int, seed: int) -> "np.ndarray":  # noqa: F821
        """Multilinear hashes of all runs of that many words."""
        import numpy as np

        factors = np.random.default_rng(seed).integers(0, 1 << 63, length + 1, np.uint64)
        n = max(0, len(self.hashes) - length + 1)
        made = np.full(n, factors[length], np.uint64)
        for i in range(length):
            made += (self.hashes[i : i + n] ^ (self.hashes[i : i + n] >> np.uint64(29))) * (
                factors[i] << np.uint64(1) | np.uint64(1)
            )
        made ^= made >> np.uint64(32)
        made *= np.uint64(0x9E3779B97F4A7C15)
        return made ^ (made >> np.uint64(29))

    def anchors(self) -> "np.ndarray":  # noqa: F821
        """For each window the smallest hash of its runs of ``ANCHOR_WORDS`` words."""
        import numpy as np

        low = self._runs(min(ANCHOR_WORDS, self.window), 1)
        wide = self.window - min(ANCHOR_WORDS, self.window) + 1
        have = 1
        while have < wide:
            step = min(have, wide - have)
            low = np.minimum(low[: len(low) - step], low[step:])
            have += step
        return low[self.place]

    def keys(self) -> tuple["np.ndarray", "np.ndarray"]:  # noqa: F821
        """Hashes of 64 and of 32 further bits of each window."""
        import numpy as np

        main = self._runs(self.window, 2)[self.place]
        check = self._runs(self.window, 3)[self.place]
        return main, (check >> np.uint64(32)).astype(np.uint32)


def _blocks(docs: DataFrame) -> DataFrame:
    """One row for each run of documents in a partition, words joined by one blank."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 33
        owners: list[int | None] = []
        texts: list[bytes] = []
        size = 0

        def made() -> pa.RecordBatch:
            values = [number, *_pack(owners, texts)]
            kinds = [pa.int64(), *[pa.binary()] * 4]
            return pa.RecordBatch.from_arrays(
                [pa.array([v], k) for v, k in zip(values, kinds)],
                names=["block", "owners", "nulls", "sizes", "texts"],
            )

        for batch in batches:
            for owner, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text"))):
                joined = b" ".join((text or "").encode("utf-8", "surrogatepass").split())
                if texts and size + len(joined) > BLOCK_BYTES:
                    yield made()
                    number += 1
                    owners, texts, size = [], [], 0
                owners.append(owner)
                texts.append(joined)
                size += len(joined)
        if texts:
            yield made()

    return docs.mapInArrow(run, BLOCK)


def _each(df: DataFrame, work_on, schema: str, columns: list[str]) -> DataFrame:
    """Apply a function of one row's values to each row; it yields lists of columns."""
    from pyspark.sql.pandas.types import to_arrow_schema

    kinds = to_arrow_schema(df.sparkSession.createDataFrame([], schema).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                values = [batch.column(c)[i].as_py() for c in columns]
                for made in work_on(*values):
                    arrays = [
                        pa.array(v, f.type) for v, f in zip(made, kinds)
                    ]
                    yield pa.RecordBatch.from_arrays(arrays, names=kinds.names)

    return df.select(*columns).mapInArrow(run, schema)


def _dealt(block: int, groups: int, key, *more) -> list[list]:
    """Rows (group, block, bytes of key, bytes of each of ``more``), by remainders of the key."""
    import numpy as np

    group = (key % np.uint64(groups)).astype(np.int64)
    order = np.argsort(group, kind="stable")
    group = group[order]
    cuts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if len(group) else []
    ends = np.r_[cuts[1:], len(group)] if len(group) else []
    sorted_ = [a[order] for a in (key, *more)]
    rows: list[list] = [[], []]
    data: list[list[bytes]] = [[] for _ in sorted_]
    for a, b in zip(cuts, ends):
        rows[0].append(int(group[a]))
        rows[1].append(block)
        for column, values in zip(data, sorted_):
            column.append(values[a:b].tobytes())
    return [*rows, *data]


def _answers(blocks, found, *arrays) -> list[list]:
    """Rows (block, bytes of each array) of the entries that are found, by block."""
    import numpy as np

    owner = blocks[found]
    order = np.argsort(owner, kind="stable")
    owner = owner[order]
    cuts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]]) if len(owner) else []
    ends = np.r_[cuts[1:], len(owner)] if len(owner) else []
    parts = [a[found][order] for a in arrays]
    return [
        [int(owner[a]) for a in cuts],
        *[[p[a:b].tobytes() for a, b in zip(cuts, ends)] for p in parts],
    ]


def _gathered(table: pa.Table, kinds: dict[str, str]) -> tuple[list, "np.ndarray"]:  # noqa: F821
    import numpy as np

    columns = {c: table.column(c).to_pylist() for c in kinds}
    arrays = [np.frombuffer(b"".join(columns[c]), kind) for c, kind in kinds.items()]
    first, kind = next(iter(kinds.items()))
    each = [len(v) // np.dtype(kind).itemsize for v in columns[first]]
    return arrays, np.repeat(np.array(table.column("block").to_pylist(), np.int64), each)


def parse(
    docs: DataFrame, *, window: int = 13, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_words, n_removed, factors, kept.

    ``factors`` holds start and length in words, reference document and start there, of
    each duplicate span, in order; spans may overlap. ``kept`` is the text that is left,
    its words joined by one blank.
    """
    spark = docs.sparkSession
    folder = work(spark)
    narrow = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")
    )
    size = narrow.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    groups = max(1, -(-size // GROUP_BYTES))
    # Joins shuffle a table with fewer buckets than shuffles have partitions.
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = min(max(least, -(-size // BUCKET_BYTES)), MOST_BUCKETS)
    name = f"glossa_blocks_{uuid.uuid4().hex}"
    (
        _blocks(narrow).repartition(buckets, "block").write.bucketBy(buckets, "block")
        .sortBy("block").option("path", folder.path("blocks")).saveAsTable(name)
    )
    blocks = spark.table(name)
    parts = ["block", "owners", "nulls", "sizes", "texts"]

    def anchors(block, owners, nulls, sizes, texts):
        import numpy as np

        made = Block(owners, nulls, sizes, texts, window)
        key, doc = made.anchors(), made.doc
        if not len(key):
            return
        new = np.r_[True, (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])]
        key, doc = key[new], doc[new]
        order = np.argsort(key)
        key, doc = key[order], doc[order]
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        several = np.minimum.reduceat(doc, first) != np.maximum.reduceat(doc, first)
        yield _dealt(block, groups, key[first], several.astype(np.uint8))

    def repeated(table: pa.Table) -> pa.Table:
        import numpy as np

        (key, several), owner = _gathered(table, {"key": "<u8", "several": "u1"})
        order = np.argsort(key)
        new = np.r_[True, key[order][1:] != key[order][:-1]]
        which = np.empty(len(key), np.int64)
        which[order] = np.cumsum(new) - 1
        times = np.bincount(which, 1 + several.astype(np.int64))
        made = _answers(owner, times[which] > 1, key)
        return pa.table({"block": pa.array(made[0], pa.int64()), "known": pa.array(made[1], pa.binary())})

    sent = _each(blocks, anchors, "grp long, block long, key binary, several binary", parts)
    known = sent.groupBy("grp").applyInArrow(repeated, "block long, known binary")
    known = known.groupBy("block").agg(F.collect_list("known").alias("known"))

    def windows(block, owners, nulls, sizes, texts, known):
        import numpy as np

        made = Block(owners, nulls, sizes, texts, window)
        wanted = np.isin(made.anchors(), np.frombuffer(b"".join(known), "<u8"))
        key, check = (a[wanted] for a in made.keys())
        doc = made.doc[wanted]
        at = (made.place - made.starts[made.row])[wanted]
        order = np.lexsort((at, doc, check, key))
        key, check, doc, at = (a[order] for a in (key, check, doc, at))
        # In the order of the text again, in which documents and places pack well.
        first = np.r_[True, (key[1:] != key[:-1]) | (check[1:] != check[:-1])][: len(key)]
        back = np.argsort(order[first])
        if len(key):
            found = (key, check, doc, at.astype(np.uint32))
            yield _dealt(block, groups, *(a[first][back] for a in found))

    def references(table: pa.Table) -> pa.Table:
        import numpy as np

        (key, check, doc, at), owner = _gathered(table, ENTRY)
        order = np.lexsort((at, doc, check, key))
        a, b = key[order], check[order]
        first = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]
        lead = np.empty(len(key), np.int64)
        lead[order] = order[np.flatnonzero(first)[np.cumsum(first) - 1]]
        made = _answers(owner, doc[lead] < doc, key, check, doc[lead], at[lead])
        kinds = [pa.int64(), *[pa.binary()] * 4]
        names = ["block", "key", "chk", "doc", "at"]
        return pa.table({n: pa.array(v, k) for n, v, k in zip(names, made, kinds)})

    told = blocks.join(known, "block")
    schema = "grp long, block long, key binary, chk binary, doc binary, at binary"
    sent = _each(told, windows, schema, [*parts, "known"])
    schema = "block long, key binary, chk binary, doc binary, at binary"
    found = sent.groupBy("grp").applyInArrow(references, schema)
    found = found.groupBy("block").agg(
        F.collect_list(F.struct("key", "chk", "doc", "at")).alias("found")
    )

    def factors(block, owners, nulls, sizes, texts, found):
        import numpy as np

        made = Block(owners, nulls, sizes, texts, window)
        key, check = made.keys()
        at = made.place - made.starts[made.row]
        told = [
            np.frombuffer(b"".join([f[c] for f in found or ()]), kind)
            for c, kind in ENTRY.items()
        ]
        n = len(key)
        both = [np.concatenate(x) for x in zip((key, check, made.doc, at), told)]
        order = np.lexsort((both[3], both[2], both[1], both[0]))
        key, check, doc, place = (a[order] for a in both)
        first = np.r_[True, (key[1:] != key[:-1]) | (check[1:] != check[:-1])][: len(key)]
        lead = np.flatnonzero(first)[np.cumsum(first) - 1]
        ref_doc, ref_at = np.empty(len(key), np.int64), np.empty(len(key), np.int64)
        ref_doc[order], ref_at[order] = doc[lead], place[lead]
        hit = np.flatnonzero(ref_doc[:n] < made.doc)
        step = np.diff(made.place[hit]) == 1
        step &= (np.diff(made.row[hit]) == 0) & (np.diff(ref_doc[hit]) == 0)
        step &= np.diff(ref_at[hit]) == 1
        opens = hit[np.r_[True, ~step][: len(hit)]]
        closes = hit[np.r_[~step, True][: len(hit)]] if len(hit) else hit
        cover = np.zeros(len(made.hashes) + 1, np.int64)
        np.add.at(cover, made.place[opens], 1)
        np.add.at(cover, made.place[closes] + window, -1)
        gone = np.cumsum(cover[:-1]) > 0
        spans: dict[int, list[dict]] = {}
        for a, b in zip(opens.tolist(), closes.tolist()):
            spans.setdefault(int(made.row[a]), []).append(
                {
                    "start": int(at[a]), "length": b - a + window,
                    "ref_doc": int(ref_doc[a]), "ref_start": int(ref_at[a]),
                }
            )
        columns: list[list] = [[], [], [], [], []]
        for i, words in enumerate(made.words):
            start = int(made.starts[i])
            lost = 0
            if i in spans:
                mask = gone[start : start + len(words)].tolist()
                lost = sum(mask)
                kept = b" ".join([w for w, g in zip(words, mask) if not g])
            else:
                kept = b" ".join(words)
            owner = None if nulls[i] else int(made.owners[i])
            row = (owner, len(words), lost, spans.get(i, []), kept.decode("utf-8", "replace"))
            for column, value in zip(columns, row):
                column.append(value)
            if i % 1000 == 999:
                yield columns
                columns = [[], [], [], [], []]
        yield columns

    schema = (
        "doc_id long, n_words long, n_removed long, factors array<struct<start: long, "
        "length: long, ref_doc: long, ref_start: long>>, kept string"
    )
    return _each(blocks.join(found, "block", "left"), factors, schema, [*parts, "found"])
