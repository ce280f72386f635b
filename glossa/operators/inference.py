"""Batch inference: every distinct chunk is translated once."""

from __future__ import annotations

import time
import uuid
from collections.abc import Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from itertools import groupby

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from glossa.backends import Backend, BackendError, Request
from glossa.functions.text import prompt_parts
from glossa.operators import filters
from glossa.settings import JobParams
from glossa.session import CODEC, FileSystem, task_folder

RESULT_FIELDS = [
    T.StructField("tgt", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("attempts", T.IntegerType()),
]
REASON_FIELD = T.StructField("reason", T.StringType())
RESULT_TYPES = {
    "tgt": pa.string(), "status": pa.string(), "attempts": pa.int32(), "reason": pa.string(),
}
EMPTY = "the answer was empty"
REASON_CHARS = 300

MEMORY_SCHEMA = T.StructType(
    [
        T.StructField("key", T.StringType()),
        T.StructField("src", T.StringType()),
        *RESULT_FIELDS,
        REASON_FIELD,
        T.StructField("prompt_hash", T.StringType()),
        T.StructField("model", T.StringType()),
        T.StructField("source_lang", T.StringType()),
        T.StructField("target_lang", T.StringType()),
    ]
)

# A key with more than a thousandth of all chunks is spread over several tasks;
# there can be no more than a thousand of those.
HOT_KEYS = 1000
HOT_MIN_ROWS = 100_000

# One inference task repeats at most so many calls when its executor is lost, as
# long as the number of tasks stays one the driver can schedule.
CHUNKS_PER_TASK = 2000
MAX_TASKS = 50_000

# Below the memory: results of commits that are being written, and the name of the file
# there that ends them.
STAGED = "_staged"
STOP = "_stop"

# Texts of so many rows and bytes are held in a task at a time.
PART_ROWS = 1000
PART_BYTES = 1 << 20

# Results are committed after so many calls at the latest.
COMMIT_CHUNKS = 5_000_000
CHUNKS_PER_FILE = 10_000

# Up to so many keys (some 20 MB) are sent to all executors, to pick their rows out
# of the memory without shuffling it.
BROADCAST_KEYS = 200_000


# ------------------------------------------------------------------- one chunk


def _messages(text: str, params: JobParams) -> list[dict]:
    parts = prompt_parts(
        params.source_lang, params.target_lang, params.system_prompt, params.message_template
    )
    return [{"role": role, "content": text.join(pieces)} for role, pieces in parts]


def _attempt(
    backend: Backend, text: str | None, params: JobParams, reasons: bool = False
) -> tuple:
    """(translation or None, status, attempts), with ``reasons`` also why the last try failed;
    fatal errors go up."""
    why = None
    if text is None or not text.strip():
        return (text, "skipped", 0, why)[: 3 + reasons]
    request = Request(
        text,
        _messages(text, params),
        params.source_lang,
        params.target_lang,
        params.model,
        params.max_tokens,
    )
    for attempt in range(1, params.max_attempts + 1):
        try:
            answer = backend.complete(request).strip()
            why = None if answer else EMPTY
        except BackendError as e:
            answer, why = "", str(e)[:REASON_CHARS]
        if answer:
            return (answer, "ok", attempt, why)[: 3 + reasons]
        if attempt < params.max_attempts:
            time.sleep(params.retry_wait * attempt)
    return (None, "failed", params.max_attempts, why)[: 3 + reasons]


def _parts(batch: pa.RecordBatch, at: int) -> Iterator[pa.RecordBatch]:
    """A batch in runs of rows whose texts are few and short enough to be held as objects,
    beside their answers; a text that is longer is a run of its own."""
    sizes = pc.fill_null(pc.binary_length(batch.column(at)), 0).to_pylist()
    start = held = 0
    for i, size in enumerate(sizes):
        if i > start and (i - start >= PART_ROWS or held + size > PART_BYTES):
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += size
    if start < len(sizes):
        yield batch.slice(start)


def translate_chunks(
    df: DataFrame,
    backend: Backend,
    params: JobParams,
    chunk: str = "chunk",
    in_flight: int = 1,
    reasons: bool = False,
) -> DataFrame:
    """Add (tgt, status, attempts) to every row; one backend call per row and try.

    With ``reasons`` also why the last try failed: what the backend said, or that its
    answer was empty.

    ``in_flight`` requests run at a time in each task. The result of a model is
    neither cheap nor repeatable, so write it before using it twice.
    """
    at = df.columns.index(chunk)
    fields = [*RESULT_FIELDS, REASON_FIELD] if reasons else RESULT_FIELDS
    kinds = {f.name: RESULT_TYPES[f.name] for f in fields}
    schema = T.StructType([*df.schema.fields, *fields])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with ThreadPoolExecutor(in_flight) as pool:
            for batch in batches:
                yield from _answered(batch, at, kinds, backend, params, pool, reasons)

    return df.mapInArrow(run, schema)


def _answered(
    whole: pa.RecordBatch, at: int, kinds: dict[str, pa.DataType], backend: Backend,
    params: JobParams, pool: ThreadPoolExecutor, reasons: bool,
) -> Iterator[pa.RecordBatch]:
    """The rows of a batch with what the backend made of their texts."""
    for batch in _parts(whole, at):
        texts = batch.column(at).to_pylist()
        done = list(pool.map(lambda t: _attempt(backend, t, params, reasons), texts))
        added = [pa.array(values, type=kind) for values, kind in zip(zip(*done), kinds.values())]
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, *added], names=[*batch.schema.names, *kinds]
        )


def _pieces_by(batch: pa.RecordBatch, column: str) -> Iterator[tuple[str, pa.RecordBatch]]:
    """A batch in runs of rows that are equal in a column, each with that value."""
    start = 0
    for value, rows in groupby(batch.column(column).to_pylist()):
        size = sum(1 for _ in rows)
        yield value, batch.slice(start, size)
        start += size


def open_to_tasks(spark: SparkSession, folder: str) -> bool:
    """Whether tasks can write to a folder, which is made, without Spark."""
    fs = FileSystem(spark, folder)
    fs.make(folder)
    uri = fs.uri(folder)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _ in batches:
            try:
                store, base = task_folder(uri)
                with store.open_output_stream(f"{base}/_try") as out:
                    out.write(b"1")
                store.move(f"{base}/_try", f"{base}/_tried")
                can = True
            except (OSError, ValueError, NotImplementedError):
                can = False
            yield pa.RecordBatch.from_pydict({"can": [can]})

    tried = spark.range(0, 1, 1, 1).mapInArrow(run, "can boolean").first()
    return tried["can"] and fs.exists(f"{folder}/_tried")


def keep_translations(
    df: DataFrame, backend: Backend, params: JobParams, staged: str, folder: str,
    in_flight: int = 1,
) -> DataFrame:
    """(part): translate chunks (key, chunk, part), and store the results of each part.

    The rows of a part follow each other in one task. Their results are written to
    ``staged`` and moved to ``folder`` before the next part begins, so they stay whatever
    becomes of the task, and a task that is run again does not call the backend for them.
    A file ``STOP`` in ``staged`` ends all tasks before their next part; a task that was
    begun has one.
    """
    fields = [*RESULT_FIELDS, REASON_FIELD]
    kinds = {f.name: RESULT_TYPES[f.name] for f in fields}
    same = {"prompt_hash": params.prompt_hash, "model": params.model}

    def stored(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = {"key": batch.column("key"), "src": batch.column("chunk")}
        found |= {name: batch.column(name) for name in kinds}
        found |= {name: pa.array([value] * len(batch), pa.string()) for name, value in same.items()}
        return pa.RecordBatch.from_pydict(found)

    def write(fs: pafs.FileSystem, path: str, batches: Iterable[pa.RecordBatch]) -> None:
        out = None
        try:
            for batch in map(stored, batches):
                out = out or pq.ParquetWriter(
                    path, batch.schema, filesystem=fs, compression=CODEC
                )
                out.write_batch(batch)
        finally:
            if out:
                out.close()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (fs, aside), (_, base) = task_folder(staged), task_folder(folder)
        attempt = TaskContext.get().taskAttemptId()
        pieces = (piece for batch in batches for piece in _pieces_by(batch, "part"))
        with ThreadPoolExecutor(in_flight) as pool:
            for i, (part, rows) in enumerate(groupby(pieces, lambda piece: piece[0])):
                places = [f"{base}/{part}", f"{aside}/{STOP}"]
                there, stop = (f.type != pafs.FileType.NotFound for f in fs.get_file_info(places))
                if stop and i:
                    return
                if not there:
                    done = (
                        batch for _, piece in rows
                        for batch in _answered(piece, 1, kinds, backend, params, pool, True)
                    )
                    write(fs, f"{aside}/{attempt}-{part}", done)
                    fs.move(f"{aside}/{attempt}-{part}", f"{base}/{part}")
                yield pa.RecordBatch.from_pydict({"part": [part]})

    return df.select("key", "chunk", "part").mapInArrow(run, "part string")


def canary_check(
    spark: SparkSession, backend: Backend, params: JobParams, text: str = "Hello"
) -> DataFrame:
    """One small translation in a task, to see that the backend works at all."""
    probe = spark.createDataFrame([(text,)], "chunk string")
    return translate_chunks(probe, backend, params)


# ---------------------------------------------------------------------- memory


def chunk_key(chunk: Column | str, params: JobParams) -> Column:
    """Equal for chunks whose translation is the same: 128 bits of a SHA-256."""
    text = F.col(chunk) if isinstance(chunk, str) else chunk
    return F.substring(F.sha2(F.concat_ws("\x1f", F.lit(params.scope), text), 256), 1, 32)


def dedupe_chunks(chunks: DataFrame) -> DataFrame:
    """Distinct (key, chunk). Repeats are dropped before the shuffle already.

    Both are grouped by, as a text that is an aggregate would be sorted on either side
    of the shuffle; equal keys have equal texts.
    """
    return chunks.select("key", "chunk").distinct()


class TranslationMemory:
    """Stored results of the backend, so that no chunk is translated twice.

    Files are never changed. Once there are many, each has filters of its keys beside the
    memory, see ``filters``, and a short list of keys opens only files that may hold some.
    """

    def __init__(self, spark: SparkSession, path: str, min_files: int = filters.MIN_FILES):
        self.spark = spark
        self.path = path
        self.min_files = min_files

    def rows(self) -> DataFrame:
        if not FileSystem(self.spark, self.path).has_data(self.path):
            return self.spark.createDataFrame([], MEMORY_SCHEMA)
        return self.spark.read.schema(MEMORY_SCHEMA).parquet(self.path)

    def known(self, params: JobParams, among: DataFrame | None = None) -> DataFrame:
        """(key, tgt) of this scope's successes; two runs may have stored a key twice.

        Keys repeat rarely, so they are brought together first: the later sort and
        join then use that one shuffle. ``among`` is a short list of keys to look up.
        """
        pairs = self._good(params, among).select("key", "tgt")
        return pairs.repartition("key").dropDuplicates(["key"])

    def missing(
        self, chunks: DataFrame, params: JobParams, among: DataFrame | None = None,
        parts: int | None = None, place: dict[str, Column] | None = None,
    ) -> DataFrame:
        """Distinct chunks without a stored success.

        With ``parts`` the texts move once, into so many partitions by key, or by the
        columns of ``place``, which are made of the key and stay: for chunks of which few
        repeat, and none very often.
        """
        place = place or {}
        if parts is None:
            new = dedupe_chunks(chunks).withColumns(place)
        else:
            dealt = chunks.select("key", "chunk").withColumns(place)
            new = dealt.repartition(parts, *(place or ["key"])).distinct()
        if not FileSystem(self.spark, self.path).has_data(self.path):
            return new
        found = self._good(params, among).select("key").withColumns(place)
        return new.join(found, ["key", *place], "left_anti")

    def lost(self, params: JobParams, among: DataFrame | None = None) -> DataFrame:
        """Keys whose last or an earlier try gave no translation."""
        return self._mine(self.opened(among), params).where(F.col("status") != "ok").select("key")

    def failures(self, params: JobParams) -> DataFrame:
        """(src, attempts, reason) of chunks that failed, and why they did the last time."""
        failed = self._mine(self.rows(), params).where(F.col("status") == "failed")
        return failed.select("key", "src", "attempts", "reason")

    def append(self, results: DataFrame, params: JobParams, aside: bool = False) -> None:
        """Store results. With ``aside`` they are moved in when all are written, so several
        appends can run at a time, and whoever makes them calls ``add_filters`` once."""
        reason = F.col("reason") if "reason" in results.columns else F.lit(None).cast("string")
        stored = results.select(
            "key",
            F.col("chunk").alias("src"),
            *(f.name for f in RESULT_FIELDS),
            reason.alias("reason"),
            F.lit(params.prompt_hash).alias("prompt_hash"),
            F.lit(params.model).alias("model"),
        )
        # All rows are of one partition; naming its folder saves a sort.
        folder = self._folder(params)
        if not aside:
            stored.write.mode("append").parquet(folder, compression=CODEC)
            self.add_filters()
            return
        staged = self.staged()
        fs = FileSystem(self.spark, staged)
        try:
            stored.write.parquet(staged, compression=CODEC)
            fs.move_files(staged, folder, "")
        finally:
            fs.delete(staged)

    def _folder(self, params: JobParams) -> str:
        return f"{self.path}/source_lang={params.source_lang}/target_lang={params.target_lang}"

    def staged(self) -> str:
        """A folder for results that are being written; whoever makes it deletes it."""
        return f"{self.path}/{STAGED}/{uuid.uuid4().hex}"

    def append_parts(
        self, todo: DataFrame, backend: Backend, params: JobParams, staged: str, tasks: int,
        in_flight: int = 1,
    ) -> int:
        """Translate stored chunks in so many tasks at most, and store the results of each of
        their files as soon as they are there; tells how many files that were.

        ``todo`` is a scan; ``staged`` must be open to tasks. Whoever calls it also calls
        ``add_filters``, once.
        """
        fs, folder = FileSystem(self.spark, staged), self._folder(params)
        fs.make(folder)
        # A file may be read in several splits, each of which is always the same rows.
        split, name = F.col("_metadata.file_block_start"), F.col("_metadata.file_name")
        part = F.concat(F.lit("part-"), split.cast("string"), F.lit("-"), name)
        chunks = todo.select("key", "chunk", part.alias("part")).coalesce(tasks)
        kept = keep_translations(chunks, backend, params, fs.uri(staged), fs.uri(folder), in_flight)
        return len(kept.collect())  # names of as many files as the caller asks for

    def add_filters(self) -> None:
        """Filters for all files that have none yet, as long as there are many files."""
        rows = self.rows()
        if len(rows.inputFiles()) > self.min_files:
            filters.add(self.spark, rows.where(F.col("status") == "ok"), self.path)

    def opened(self, among: DataFrame | None) -> DataFrame:
        """The rows of files that may hold some of the keys; of all files without a list."""
        rows = self.rows()
        if among is None or len(rows.inputFiles()) <= self.min_files:
            return rows
        return filters.pruned(self.spark, rows, self.path, among)

    @staticmethod
    def _mine(rows: DataFrame, params: JobParams) -> DataFrame:
        return rows.where(
            (F.col("source_lang") == params.source_lang)
            & (F.col("target_lang") == params.target_lang)
            & (F.col("prompt_hash") == params.prompt_hash)
            & (F.col("model") == params.model)
        )

    def _good(self, params: JobParams, among: DataFrame | None) -> DataFrame:
        good = self._mine(self.opened(among), params).where(F.col("status") == "ok")
        return good if among is None else good.join(F.broadcast(among), "key", "left_semi")


# ------------------------------------------------------------------- hot chunks


def hot_salts(
    chunks: DataFrame, total: int, min_rows: int = HOT_MIN_ROWS
) -> list[tuple[str, int]]:
    """(key, number of salts) for keys with more rows than one task should get.

    Reads the key column only. Fewer than ``HOT_KEYS`` keys can have that many.
    """
    share = max(total // HOT_KEYS, min_rows, 1)
    if total <= share:
        return []
    counts = chunks.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > share)
    return [(r["key"], -(-r["n"] // share)) for r in counts.collect()]


def attach_translations(
    addresses: DataFrame, known: DataFrame, hot: list[tuple[str, int]]
) -> DataFrame:
    """Left join on the key; rows of hot keys are spread over salts.

    ``hot`` only decides where rows go: the result is the same with any list.
    """
    if not hot:
        return addresses.join(known, "key", "left")
    salts = F.broadcast(addresses.sparkSession.createDataFrame(hot, "key string, salts long"))
    place = F.xxhash64(*(c for c in addresses.columns if c != "key"))
    count = F.coalesce(F.col("salts"), F.lit(1))
    left = addresses.join(salts, "key", "left").withColumn("salt", F.pmod(place, count))
    right = known.join(salts, "key", "left").select(
        "key", "tgt", F.explode(F.sequence(F.lit(0).cast("long"), count - 1)).alias("salt")
    )
    return left.join(right, ["key", "salt"], "left").drop("salt", "salts")
