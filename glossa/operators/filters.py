"""Bloom filters of the keys of files, kept beside a table that only grows.

Keys are hashes, so a file has no range of keys to be left out by; but keys of one batch
were mostly stored together, and a batch that comes again finds them in few files. For
every file there are filters of ``BITS`` bits a key, which say "not here" of all but one in
four million other keys; a list of keys is held against the filters of all files, some
hundredth of the table, and only files that may hold one of them are opened. A file without
filters is always opened, so a lost driver costs time and no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from glossa.operators.rows import file_names, file_path
from glossa.session import FileSystem

FOLDER = "_filters"
KINDS = "file string, keys long, bits binary"

#: Tables of fewer files are opened as a whole.
MIN_FILES = 64

#: So many names of files can be given to a scan; more are most of a table anyway.
MOST_NAMES = 2_000

BITS = 32
HASHES = 20


def words_of(keys: list[str]) -> "np.ndarray":  # noqa: F821
    """Two 64-bit words for each key of 32 hexadecimal digits; the second is odd."""
    import numpy as np

    found = np.frombuffer(bytes.fromhex("".join(keys)), ">u8").reshape(-1, 2).astype(np.uint64)
    found[:, 1] |= np.uint64(1)
    return found


def filter_of(words: "np.ndarray") -> bytes:  # noqa: F821
    import numpy as np

    size = np.uint64(max(64, BITS * len(words)))
    bits = np.zeros(int(size), bool)
    for i in range(HASHES):
        bits[(words[:, 0] + np.uint64(i) * words[:, 1]) % size] = True
    return np.packbits(bits).tobytes()


def may_hold(bits: bytes, keys: int, words: "np.ndarray") -> bool:  # noqa: F821
    """Whether some of the words may be among the keys; each step looks at those left."""
    import numpy as np

    size = np.uint64(max(64, BITS * keys))
    held = np.unpackbits(np.frombuffer(bits, np.uint8))
    left = words
    for i in range(HASHES):
        if not len(left):
            return False
        left = left[held[(left[:, 0] + np.uint64(i) * left[:, 1]) % size] == 1]
    return len(left) > 0


def add(spark: SparkSession, rows: DataFrame, path: str) -> None:
    """Store filters of the column ``key`` for all files of ``rows`` that have none."""
    at = f"{path}/{FOLDER}"
    fresh = set(file_names(rows))
    if FileSystem(spark, at).has_data(at):
        done = spark.read.schema(KINDS).parquet(at).select("file").distinct()
        fresh -= {r["file"] for r in done.collect()}  # one name for each file of the table

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of: dict[str, list[str]] = {}
            for key, file in zip(batch.column("key").to_pylist(), batch.column("file").to_pylist()):
                of.setdefault(file, []).append(key)
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(of), pa.string()), pa.array([len(k) for k in of.values()], pa.int64()),
                 pa.array([filter_of(words_of(k)) for k in of.values()], pa.binary())],
                names=["file", "keys", "bits"],
            )

    names = sorted(fresh)
    for i in range(0, len(names), MOST_NAMES):
        named = rows.where(file_path().isin(names[i : i + MOST_NAMES]))
        named = named.select("key", file_path().alias("file"))
        named.mapInArrow(run, KINDS).write.mode("append").parquet(at)


def pruned(spark: SparkSession, rows: DataFrame, path: str, among: DataFrame) -> DataFrame:
    """Rows of files that may hold one of the keys of ``among``, a list of bounded length."""
    at = f"{path}/{FOLDER}"
    if not FileSystem(spark, at).has_data(at):
        return rows
    stored = spark.read.schema(KINDS).parquet(at)
    words = words_of([r["key"] for r in among.select("key").distinct().collect()])
    sent = spark.sparkContext.broadcast(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("file", "keys", "bits"))
            out = [may_hold(bits, keys, sent.value) for _, keys, bits in zip(*columns)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("file"), pa.array(out, pa.bool_())], names=["file", "may"]
            )

    told = stored.mapInArrow(run, "file string, may boolean")
    found = {
        r["file"]: r["may"]
        for r in told.groupBy("file").agg(F.bool_or("may").alias("may")).collect()
    }
    sent.destroy()
    wanted = [n for n in file_names(rows) if found.get(n, True)]
    return rows if len(wanted) > MOST_NAMES else rows.where(file_path().isin(wanted))
