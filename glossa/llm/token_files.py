"""Token ids of documents in binary shards, each document compressed apart.

A store is a folder:

    dictionary          a zstandard dictionary, trained on serialized id arrays
    part-00000.tok ...  shards, in ascending order of doc_id
    manifest/           Parquet: shard, file, documents, tokens, first and last doc_id

A shard is the magic, the SHA-256 of the dictionary, one zstandard frame for each
document, the index, and a footer (place and length of the index, bytes of an id, magic).
The index is an Arrow stream with doc_id, end (where the frame ends) and n_tokens, so a
short document is read with three small reads and no other document is decompressed.

Shards are written by tasks, under another name until they are whole; a task that runs
again writes the same bytes. Paths may be of any store that both Spark and
``pyarrow.fs`` reach.

Defined cases: a null text is empty; a null doc_id comes first; rows equal in doc_id
come in the order of a hash of their text, which keeps repeated rows; no rows make a
store without shards. Further columns are not kept.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from glossa.llm.tokenize import encoded, with_ids

MAGIC = b"TOKZ0001"
_FOOTER = "<QQI8s"
_HEAD = len(MAGIC) + 32

#: The sample the dictionary is trained on: documents, and characters of each, from a
#: place that a hash chooses.
SAMPLE_DOCS = 500
SAMPLE_CHARS = 16_384

#: Bytes of text in a shard, at least and at most; between these, four shards a core.
LEAST_SHARD, MOST_SHARD = 16 << 20, 256 << 20
DICTIONARY_BYTES = 65_536
LEVEL = 3


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    if path.startswith("file:") and not path.startswith("file://"):
        path = "file://" + path.removeprefix("file:")
    return pafs.FileSystem.from_uri(path)


def _narrow(raw: bytes, id_bytes: int) -> bytes:
    import numpy as np

    return raw if id_bytes == 4 else np.frombuffer(raw, "<u4").astype("<u2").tobytes()


def _wide(raw: bytes, id_bytes: int) -> bytes:
    import numpy as np

    return raw if id_bytes == 4 else np.frombuffer(raw, "<u2").astype("<u4").tobytes()


def _dictionary(data: bytes) -> Any:
    import zstandard

    return zstandard.ZstdCompressionDict(data) if data else None


def train_dictionary(ids: DataFrame, id_bytes: int) -> bytes:
    """Trained on the ids of a bounded sample; empty if the sample is too small."""
    import zstandard

    samples = [_narrow(bytes(r[0]), id_bytes) for r in ids.select("ids").collect()]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b""


def _sample(docs: DataFrame) -> DataFrame:
    """Windows of documents chosen by a hash; at most some 8 MB meet in a task."""
    mixed = F.xxhash64("doc_id", "text")
    rest = F.greatest(F.length("text") - SAMPLE_CHARS, F.lit(0)) + 1
    place = F.pmod(F.xxhash64(F.lit(1), "doc_id", "text"), rest).cast("int") + 1
    window = F.substr("text", place, F.lit(SAMPLE_CHARS))
    found = docs.filter("text is not null").select(mixed.alias("_mixed"), window.alias("text"))
    return found.orderBy("_mixed", "text").limit(SAMPLE_DOCS).select("text")


def _shards(docs: DataFrame) -> int:
    size = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    many = 4 * docs.sparkSession.sparkContext.defaultParallelism
    return max(1, -(-size // min(max(size // many, LEAST_SHARD), MOST_SHARD)))


def write_store(
    docs: DataFrame,
    folder: str,
    tokenizer: str,
    *,
    end_id: int,
    id_bytes: int = 4,
    doc_id: str = "doc_id",
    text: str = "text",
) -> str:
    """Write the store of all documents and give back its folder."""
    narrow = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    data = train_dictionary(with_ids(_sample(narrow), tokenizer, end_id, text="text"), id_bytes)
    digest = hashlib.sha256(data).digest()
    fs, base = _open(folder)
    fs.create_dir(base, recursive=True)
    with fs.open_output_stream(f"{base}/dictionary") as out:
        out.write(data)

    kind = narrow.select(F.col("doc_id").alias("first")).schema["first"].dataType
    schema = "shard int, file string, documents long, tokens long"
    schema = spark_schema(docs.sparkSession, schema).add("first", kind).add("last", kind)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        context = TaskContext.get()
        shard = context.partitionId()
        packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=_dictionary(data))
        fs, base = _open(folder)
        name = f"part-{shard:05d}.tok"
        aside = f"{base}/.{name}.{context.taskAttemptId()}"
        owners: list[pa.Array] = []
        ends: list[int] = []
        sizes: list[int] = []
        out = None
        at = _HEAD
        for batch, found in encoded(batches, tokenizer, end_id, "text"):
            if out is None:
                out = fs.open_output_stream(aside)
                out.write(MAGIC + digest)
            owners.append(batch.column("doc_id"))
            for raw in found:
                frame = packer.compress(_narrow(raw, id_bytes))
                out.write(frame)
                at += len(frame)
                ends.append(at)
                sizes.append(len(raw) // 4)
        if out is None:
            return
        ids = pa.chunked_array(owners).combine_chunks()
        index = pa.record_batch(
            [ids, pa.array(ends, pa.int64()), pa.array(sizes, pa.int64())],
            names=["doc_id", "end", "n_tokens"],
        )
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, index.schema) as stream:
            stream.write_batch(index)
        blob = sink.getvalue().to_pybytes()
        out.write(blob + struct.pack(_FOOTER, at, len(blob), id_bytes, MAGIC))
        out.close()
        fs.move(aside, f"{base}/{name}")
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([shard], pa.int32()), pa.array([name]),
                pa.array([len(sizes)], pa.int64()), pa.array([sum(sizes)], pa.int64()),
                ids.slice(0, 1), ids.slice(len(ids) - 1, 1),
            ],
            names=["shard", "file", "documents", "tokens", "first", "last"],
        )

    # Rows that are equal may be many, and come in any order.
    order = ["doc_id", "_mixed", "_tie"]
    tied = {"_mixed": F.xxhash64("text"), "_tie": F.monotonically_increasing_id()}
    placed = narrow.withColumns(tied).repartitionByRange(_shards(narrow), *order)
    placed = placed.sortWithinPartitions(*order).select("doc_id", "text")
    shards = placed.mapInArrow(write, schema)
    shards.write.mode("overwrite").parquet(f"{folder}/manifest")
    return folder


def spark_schema(spark: SparkSession, ddl: str) -> Any:
    return spark.createDataFrame([], ddl).schema


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """One row for each shard, with ``start``: the tokens in the shards before."""
    shards = spark.read.parquet(f"{folder}/manifest")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return shards.withColumn("start", F.coalesce(F.sum("tokens").over(before), F.lit(0)))


class Shard:
    """One shard, open for reading."""

    def __init__(self, folder: str, name: str):
        import zstandard

        fs, base = _open(folder)
        with fs.open_input_stream(f"{base}/dictionary") as f:
            data = f.read()
        self.file = fs.open_input_file(f"{base}/{name}")
        size = self.file.size()
        tail = struct.calcsize(_FOOTER)
        at, length, self.id_bytes, magic = struct.unpack(
            _FOOTER, self.file.read_at(tail, size - tail)
        )
        head = self.file.read_at(_HEAD, 0)
        if magic != MAGIC or not head.startswith(MAGIC):
            raise ValueError(f"{name} is not a shard")
        if head[len(MAGIC) :] != hashlib.sha256(data).digest():
            raise ValueError(f"{name} was written with another dictionary")
        self.index = pa.ipc.open_stream(self.file.read_at(length, at)).read_all().combine_chunks()
        self.unpacker = zstandard.ZstdDecompressor(dict_data=_dictionary(data))
        self.ends = self.index["end"].to_pylist()

    def document(self, row: int) -> bytes:
        """The ids of one document, as 32-bit integers."""
        start = self.ends[row - 1] if row else _HEAD
        frame = self.file.read_at(self.ends[row] - start, start)
        return _wide(self.unpacker.decompress(frame), self.id_bytes)


def read_store(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids (packed 32-bit integers) of all documents, from the files."""
    shards = manifest(spark, folder)
    kind = shards.schema["first"].dataType
    schema = spark_schema(spark, "start long, n_tokens long, ids binary")
    schema = type(schema)([type(schema.fields[0])("doc_id", kind), *schema.fields])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, start in zip(*(batch.column(c).to_pylist() for c in ("file", "start"))):
                shard = Shard(folder, name)
                owners = shard.index["doc_id"].combine_chunks()
                sizes = shard.index["n_tokens"].to_pylist()
                for first in range(0, len(sizes), 1_000):
                    rows = range(first, min(first + 1_000, len(sizes)))
                    starts, ids = [], []
                    for row in rows:
                        starts.append(start)
                        start += sizes[row]
                        ids.append(shard.document(row))
                        if len(ids[-1]) != 4 * sizes[row]:
                            raise ValueError(f"{name}: a document has another length")
                    yield pa.RecordBatch.from_arrays(
                        [
                            owners.slice(first, len(rows)), pa.array(starts, pa.int64()),
                            pa.array([sizes[r] for r in rows], pa.int64()),
                            pa.array(ids, pa.binary()),
                        ],
                        names=schema.names,
                    )

    spread = shards.select("shard", "file", "start")
    spread = spread.repartition(max(1, shards.count()), "shard")
    return spread.select("file", "start").mapInArrow(read, schema)


def read_document(spark: SparkSession, folder: str, doc_id: Any) -> list[bytes]:
    """The ids of the documents with that id, reading their frames only."""
    begun = F.col("first").isNull() | (F.col("first") <= F.lit(doc_id))
    same = begun & (F.col("last") >= F.lit(doc_id))
    found = []
    for r in manifest(spark, folder).filter(same).orderBy("shard").select("file").toLocalIterator():
        shard = Shard(folder, r["file"])
        rows = [i for i, d in enumerate(shard.index["doc_id"].to_pylist()) if d == doc_id]
        found += [shard.document(i) for i in rows]
    return found
