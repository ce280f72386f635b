"""Translate columns of a table, plain and JSON cells alike.

    table -> cells -> leaves -> chunks (stored) -> distinct new chunks
          -> backend -> memory (stored)
    chunks + memory -> pieces per row -> table

Both stored tables cut the lineage: a lost executor never calls the backend for
chunks whose results were committed.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from concurrent.futures import FIRST_COMPLETED, ThreadPoolExecutor, wait
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.util import inheritable_thread_target

from glossa.backends import Backend, FatalBackendError
from glossa.functions.jsoncell import json_rebuild, looks_json
from glossa.functions.text import is_translatable
from glossa.operators.cells import as_text, chosen_columns, spare, unpivot_cells
from glossa.operators.chunks import chunk_table
from glossa.operators.inference import (
    BROADCAST_KEYS,
    CHUNKS_PER_FILE,
    CHUNKS_PER_TASK,
    COMMIT_CHUNKS,
    HOT_MIN_ROWS,
    MAX_TASKS,
    STOP,
    TranslationMemory,
    attach_translations,
    canary_check,
    chunk_key,
    hot_salts,
    open_to_tasks,
    translate_chunks,
)
from glossa.operators.leaves import leaf_table
from glossa.operators.rows import file_names, file_path, spread_small
from glossa.session import FileSystem, WorkFolder
from glossa.settings import JobParams

FAILED = "failed_chunks"
ROW = "_row"

# So many slices of the chunks are read where they are stored; more are stored apart.
READ_SLICES = 8

# So many commits run at a time at most; the driver has a thread for each.
MOST_SIDE = 16

# Small commits are made in lots that take about so many seconds, as far as backend and
# bound on requests allow; a stop is asked for as often meanwhile.
LOT_SECONDS = 4.0


@dataclass(frozen=True)
class Engine:
    """What a translation runs on."""

    backend: Backend
    params: JobParams
    memory: TranslationMemory
    work: WorkFolder
    in_flight: int = 1
    chunks_per_task: int = CHUNKS_PER_TASK
    commit_chunks: int = COMMIT_CHUNKS
    broadcast_keys: int = BROADCAST_KEYS
    hot_min_rows: int = HOT_MIN_ROWS
    # At most so many requests are open at a time, over all tasks; None sets no bound.
    max_requests: int | None = None
    # Asked before every commit of results; True stops the translation there.
    should_stop: Callable[[], bool] | None = None
    # Told after every commit: commits done, and all commits of the rows in hand.
    on_commit: Callable[[int, int], None] | None = None

    def fresh(self) -> Engine:
        """The same engine with a work folder of its own, below this one's."""
        return replace(self, work=WorkFolder(self.work.spark, self.work.root))

    def tasks(self, chunks: int) -> int:
        """Inference tasks for so many chunks; their requests stay within the bound."""
        cores = self.work.spark.sparkContext.defaultParallelism
        wanted = min(max(-(-chunks // self.chunks_per_task), cores), MAX_TASKS)
        if self.max_requests is None:
            return wanted
        return min(wanted, max(1, self.max_requests // self.calls))

    def side_by_side(self, chunks: int, commits: int) -> tuple[int, int]:
        """Commits of so many chunks that run at a time, and the tasks of each.

        A small commit does not fill the cores, so others run beside it; the requests of
        all of them stay within the bound.
        """
        tasks = self.tasks(chunks)
        needed = min(max(-(-chunks // self.chunks_per_task), 1), tasks)
        side = min(max(tasks // needed, 1), commits, MOST_SIDE)
        return side, max(tasks // side, 1)

    @property
    def calls(self) -> int:
        """Requests of one task at a time."""
        return min(self.in_flight, self.max_requests or self.in_flight)


class Stopped(RuntimeError):
    """The translation was asked to stop; what was committed stays."""


def make_engine(
    spark, backend: Backend, params: JobParams | None = None, memory_path: str | None = None, **more
) -> Engine:
    """An engine with its own work folder, and a memory in it unless one is named."""
    work = WorkFolder(spark)
    memory = TranslationMemory(spark, memory_path or work.path("memory"))
    return Engine(backend, params or JobParams(), memory, work, **more)


def translated_pieces(leaves: DataFrame, engine: Engine) -> DataFrame:
    """Leaves (…, text) to pieces (…, chunk_idx, tgt); tgt is null where it failed.

    Runs the backend for all chunks the memory does not hold yet.
    """
    return _pieces_and_chunks(leaves, engine)[0]


def _pieces_and_chunks(leaves: DataFrame, engine: Engine) -> tuple[DataFrame, DataFrame]:
    """The pieces, and the stored chunks they were made of."""
    params = engine.params
    chunks = (
        chunk_table(leaves, "text", params.max_tokens)
        .drop("est_tokens", "path")
        .withColumn("key", chunk_key("chunk", params))
    )
    # Results of one engine may be read in any order, so each call has its own table.
    stored = engine.work.write(chunks, f"chunks-{uuid.uuid4().hex}")
    ends = stored.agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct("key").alias("keys"))
    total, keys = ends.first()
    few = total <= engine.broadcast_keys
    among = stored.select("key").distinct() if few else None
    hot = hot_salts(stored, total, engine.hot_min_rows)
    # Repeats are dropped before the shuffle if there are many, or many of one chunk.
    _translate_missing(stored, total, among, engine, unlike=not hot and 2 * keys >= total)
    known = engine.memory.known(params, among)
    return attach_translations(stored.drop("chunk"), known, hot).drop("key"), stored


def _untranslated(chunks: DataFrame, engine: Engine) -> DataFrame | None:
    """Rows of which a chunk has no translation, and maybe some more; None if there are
    too many to be sent to all executors."""
    most = engine.broadcast_keys
    keys = engine.memory.lost(engine.params).distinct()
    if keys.limit(most + 1).count() > most:
        return None
    rows = chunks.join(F.broadcast(keys), "key", "left_semi").select(ROW).distinct()
    return rows if rows.limit(most + 1).count() <= most else None


def _translate_missing(
    chunks: DataFrame, total: int, among: DataFrame | None, engine: Engine, unlike: bool
) -> None:
    """Fill the memory, with a commit after every ``commit_chunks`` chunks.

    Chunks that are mostly ``unlike`` are dealt out to their tasks by the one shuffle that
    finds repeats.
    """
    slices = max(-(-total // engine.commit_chunks), 1)
    side, tasks = engine.side_by_side(min(total, engine.commit_chunks), slices)
    if slices > READ_SLICES and engine.commit_chunks <= engine.chunks_per_task:
        _commit_files(chunks, total, among, engine, unlike, side, tasks)
        return
    number = F.pmod(F.xxhash64("key"), F.lit(slices))
    missing, params = engine.memory.missing, engine.params
    dealt = False
    if slices <= READ_SLICES:
        # So few tasks as a bound on requests leaves are too few to find repeats.
        dealt = unlike and engine.max_requests is None
        of = [chunks.where(number == i) for i in range(slices)] if slices > 1 else [chunks]
        parts = [missing(part, params, among, tasks if dealt else None) for part in of]
    else:
        files = -(-engine.commit_chunks // CHUNKS_PER_FILE)
        place = {"slice": number, "file": F.pmod(F.xxhash64("key", F.lit(1)), F.lit(files))}
        many = min(slices * files, MAX_TASKS)
        if unlike:
            spread = missing(chunks, params, among, many, place)
        else:
            spread = missing(chunks, params, among, place=place).repartition(many, *place)
        folder = f"todo-{uuid.uuid4().hex}"
        parts = engine.work.write_slices(spread.drop("file"), folder, "slice")

    def commit(lot: list[DataFrame]) -> int:
        (part,) = lot
        _commit(part if dealt else _spread(part, tasks), engine, aside=len(parts) > 1)
        return 1

    _commit_all(parts, commit, side, engine)
    if len(parts) > 1:
        engine.memory.add_filters()


def _spread(part: DataFrame, tasks: int) -> DataFrame:
    return part.repartition(tasks, "key") if tasks > 1 else part.coalesce(1)


def _commit(part: DataFrame, engine: Engine, aside: bool) -> None:
    results = translate_chunks(
        part, engine.backend, engine.params, in_flight=engine.calls, reasons=True
    )
    engine.memory.append(results, engine.params, aside=aside)


def _commit_files(
    chunks: DataFrame, total: int, among: DataFrame | None, engine: Engine, unlike: bool,
    side: int, tasks: int,
) -> None:
    """Fill the memory in many small commits, each of which is a file of new chunks.

    A job for each of them would take longer to start than to run, so the tasks of a job go
    through several files, and commit each by itself.
    """
    memory, params, spark = engine.memory, engine.params, engine.work.spark
    many = min(max(total // CHUNKS_PER_FILE, 1), MAX_TASKS)
    if unlike:
        new = memory.missing(chunks, params, among, many)
    else:
        new = memory.missing(chunks, params, among).repartition(many, "key")
    folder = f"todo-{uuid.uuid4().hex}"
    stored = engine.work.write(new, folder, engine.commit_chunks)
    files = file_names(stored)
    if len(files) == 1 and stored.isEmpty():
        return
    staged = memory.staged()
    fs = FileSystem(spark, staged)
    by_task = open_to_tasks(spark, staged)

    def commit(lot: list[str]) -> int:
        todo = stored.where(file_path().between(lot[0], lot[-1]))
        if not by_task:
            _commit(_spread(todo, tasks), engine, aside=True)
            return len(lot)
        made = memory.append_parts(
            todo, engine.backend, params, staged, min(tasks, len(lot)), engine.calls
        )
        return min(made, len(lot))

    def halt() -> None:
        fs.write_text(f"{staged}/{STOP}", "")

    try:
        _commit_all(files, commit, side, engine, tasks, halt if by_task else None)
    finally:
        fs.delete(staged)
    engine.work.delete(folder)
    memory.add_filters()


def _commit_all(
    parts: list, commit: Callable[[list], int], side: int, engine: Engine,
    at_once: int = 1, halt: Callable[[], None] | None = None,
) -> None:
    """Commit all parts in lots, ``side`` lots at a time; a lot that was begun is waited for.

    ``commit`` tells how many parts of its lot it committed. With ``halt`` a lot may have
    more parts than the ``at_once`` that are committed at the same time: as many as take
    some ``LOT_SECONDS``. It is called when the translation is to end, for the lots to end
    before their next part.
    """
    spark, stop = engine.work.spark, engine.should_stop or (lambda: False)
    at = done = 0
    most, stopped = at_once if halt else 1, False
    running: dict = {}

    def timed(lot: list) -> tuple[int, float]:
        begun = time.monotonic()
        return commit(lot), time.monotonic() - begun

    with ThreadPoolExecutor(side) as pool:
        while running or (at < len(parts) and not stopped):
            if at < len(parts) and not stopped and len(running) < side:
                lot: list = []
                size = min(most, -(-(len(parts) - at) // side))
                while len(lot) < size and not stopped:
                    stopped = stop()
                    lot += [] if stopped else [parts[at + len(lot)]]
                if lot:
                    at += len(lot)
                    # The tags of this thread's jobs go along, so a stop ends that lot too.
                    target = inheritable_thread_target(spark)(timed)
                    running[pool.submit(target, lot)] = len(lot)
            else:
                over, _ = wait(running, LOT_SECONDS if halt else None, FIRST_COMPLETED)
                stopped = stopped or bool(halt and not over and stop())
                for ended in over:
                    size = running.pop(ended)
                    try:
                        made, seconds = ended.result()
                    except Exception:
                        if halt:
                            halt()
                        raise
                    if halt and seconds > LOT_SECONDS:
                        most = max(min(most, size) // 2, at_once)
                    elif halt and seconds < LOT_SECONDS / 2 and size == most:
                        most *= 2
                    for _ in range(made):
                        done += 1
                        if engine.on_commit:
                            engine.on_commit(done, len(parts))
            if stopped and halt:
                halt()
    if stopped and done < len(parts):
        raise Stopped(f"stopped after {done} of {len(parts)} commits")


def row_key(df: DataFrame, columns: list[str], row_id: str) -> Column:
    """128 bits of a row's id and cells, and the id.

    An id may repeat, or be null: rows that are equal in all of these have the same
    translation, and no others share a key. Nothing is shuffled to tell rows apart.
    """
    parts: list[Column] = []
    for value in [F.col(f"`{row_id}`"), *(as_text(df, c) for c in columns)]:
        parts += [value.isNull(), value]
    return F.struct(
        F.xxhash64(*parts).alias("a"), F.xxhash64(F.lit(1), *parts).alias("b"),
        F.col(f"`{row_id}`").alias("id"),
    )


def _keyed(df: DataFrame, columns: list[str], row_id: str) -> tuple[DataFrame, str]:
    """The rows with their key, in a column whose name is free."""
    (key,) = spare(df, "key")
    return spread_small(df, row_id, *columns).withColumn(key, row_key(df, columns, row_id)), key


def _cells(df: DataFrame, columns: list[str], key: str) -> DataFrame:
    """Cells (``_row``, column, cell); no other names of the table go with them."""
    return unpivot_cells(df, key, columns).withColumnRenamed(key, ROW)


def translate_rows(
    df: DataFrame, columns: list[str], engine: Engine, row_id: str = "row_id"
) -> DataFrame:
    """``df`` with ``columns`` translated, plus the number of failed chunks per row.

    ``row_id`` may repeat or be null. ``df`` is read twice, so it should be a stored
    table. Cells without text pass through; a leaf of which any chunk failed keeps its
    original text.
    """
    names = chosen_columns(df, columns)
    if FAILED in (c.lower() for c in df.columns):
        raise ValueError(f"the table already has a column {FAILED}")
    rows, key = _keyed(df, names, row_id)
    params = engine.params
    cells = _cells(rows, names, key)
    leaves = leaf_table(cells, params.json_mode, params.translate_keys, params.skip_keys)
    pieces, chunks = _pieces_and_chunks(leaves, engine)
    some = [f"{kind}_{i}" for kind in ("found", "cell", "full") for i in range(len(names))]
    row, found, lost, *free = spare(df, "row", "found", "lost", *some)
    n = len(names)
    free, cell_names, full_names = free[:n], free[n : 2 * n], free[2 * n :]
    slim = _slim(df, rows, names, key, lost, cell_names, full_names, _untranslated(chunks, engine), params)
    # One shuffle brings all pieces of a row together. Rows that are equal bring the same
    # pieces, which a set holds once, so the group is a row.
    piece = F.struct("column", "leaf_ord", "chunk_idx", "tgt")
    per_row = pieces.groupBy(F.col(ROW).alias(row)).agg(
        F.array_sort(F.collect_set(piece)).alias(found)
    )
    joined = slim.join(per_row, F.col(key) == F.col(row), "left").withColumns(
        {name: _pieces_of(found, c) for name, c in zip(free, names)}
    )
    new = {
        c: _assembled(F.col(cell), F.col(full), F.col(name), params)
        for c, cell, full, name in zip(names, cell_names, full_names, free)
    }
    failed = F.size(F.filter(found, lambda p: p["tgt"].isNull())).cast("long")
    return joined.select(
        *(new[c].alias(c) if c in new else F.col(f"`{c}`") for c in df.columns),
        F.when(F.col(found).isNull(), F.lit(0)).otherwise(failed).alias(FAILED),
    )


def _pieces_of(found: str, column: str) -> Column:
    mine = F.filter(found, lambda p: p["column"] == column)
    return F.transform(
        mine, lambda p: F.struct(p["leaf_ord"].alias("leaf_ord"), p["tgt"].alias("tgt"))
    )


def _slim(
    df: DataFrame, rows: DataFrame, names: list[str], key: str, lost: str, cells: list[str],
    full: list[str], untranslated: DataFrame | None, params: JobParams,
) -> DataFrame:
    """The rows with their cells as text, and whether these hold any; a plain cell of which
    all chunks have a translation is left out, as only the translation is needed."""
    if untranslated is None:
        needed = F.lit(True)
    else:
        marks = F.broadcast(untranslated.select(F.col(ROW).alias(lost)))
        rows = rows.join(marks, F.col(key) == F.col(lost), "left")
        needed = F.col(lost).isNotNull()
    more = []
    for c, cell, holds in zip(names, cells, full):
        text = as_text(df, c)
        held = F.coalesce(is_translatable(text), F.lit(False))
        kept = needed | ~held
        if params.json_mode != "off":
            kept = kept | F.coalesce(looks_json(text), F.lit(False))
        more += [F.when(kept, text).alias(cell), held.alias(holds)]
    others = [F.col(f"`{c}`") for c in df.columns if c not in names]
    return rows.select(*others, key, *more)


def _assembled(cell: Column, full: Column, pieces: Column, params: JobParams) -> Column:
    done = F.forall(pieces, lambda p: p["tgt"].isNotNull())
    gone = F.raise_error(F.lit("a translation is no longer in the memory")).cast("string")
    plain = F.when(done, F.array_join(F.transform(pieces, lambda p: p["tgt"]), " "))
    plain = F.coalesce(plain, cell, gone)
    if params.json_mode != "off":
        document = json_rebuild(cell, pieces, params.translate_keys, params.skip_keys)
        plain = F.coalesce(document, plain)
    return F.when(full, plain).otherwise(cell)


def _whole(pieces: DataFrame, keys: list[str], into: str) -> DataFrame:
    """Pieces of a text put together; null if one is missing. Equal rows have one text."""
    ordered = F.array_sort(F.collect_set(F.struct("chunk_idx", "tgt")))
    done = F.forall("_pieces", lambda p: p["tgt"].isNotNull())
    text = F.when(done, F.array_join(F.transform("_pieces", lambda p: p["tgt"]), " "))
    return pieces.groupBy(*keys).agg(ordered.alias("_pieces")).select(*keys, text.alias(into))


def translate_plain(
    df: DataFrame, column: str, engine: Engine, row_id: str = "row_id"
) -> DataFrame:
    """(row_id, source, translation) of a text column without looking for JSON."""
    rows, key = _keyed(df, [column], row_id)
    leaves = leaf_table(_cells(rows, [column], key), "off")
    row, text = spare(df, "row", "text")
    texts = _whole(translated_pieces(leaves, engine), [ROW], text).withColumnRenamed(ROW, row)
    source = as_text(df, column)
    return rows.join(texts, F.col(key) == F.col(row), "left").select(
        row_id, source.alias("source"), F.coalesce(text, source).alias("translation")
    )


def translation_pairs(
    df: DataFrame, columns: list[str], engine: Engine, row_id: str = "row_id"
) -> DataFrame:
    """Every translated leaf beside its source: what a reviewer reads."""
    params = engine.params
    rows, key = _keyed(df, columns, row_id)
    cells = _cells(rows, columns, key)
    leaves = leaf_table(cells, params.json_mode, params.translate_keys, params.skip_keys)
    # Read twice, so stored: the cells are parsed once.
    leaves = engine.work.write(leaves, f"leaves-{uuid.uuid4().hex}")
    at = [ROW, "column", "leaf_ord"]
    found = _whole(translated_pieces(leaves, engine), at, "target").where("target is not null")
    pairs = leaves.withColumnRenamed("text", "source").join(found, at)
    return pairs.select(
        F.col(f"{ROW}.id").alias(row_id), "column", "leaf_ord", "path", "source", "target"
    )


def require_backend(spark, engine: Engine) -> None:
    """Do not start a job whose backend cannot translate one word."""
    reply = canary_check(spark, engine.backend, engine.params).first()
    if reply is None or reply["status"] != "ok":
        raise FatalBackendError("the backend gave no translation; the job was not started")
