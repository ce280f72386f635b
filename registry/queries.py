"""One query per operator, over the whole of the given tables."""

from __future__ import annotations

import sys
from collections.abc import Callable
from dataclasses import replace

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from glossa.backends import FatalBackendError, FaultyBackend, StubBackend
from glossa.functions import jsoncell, text as tx
from glossa.operators import cells, chunks, inference, leaves, profile, rows, sketches
from glossa.plans import control, dataset, jobs, runs, translate
from glossa.session import FileSystem, WorkFolder
from glossa.settings import PROMPT_PRESETS, JobParams
from glossa.sources import lake, publish, tables
from glossa.streaming import incremental
from glossa.streaming.incremental import translate_stream
from registry.backends import LastBackend, SlowBackend, TellingBackend

# Backends of the queries go along with the tasks.
cloudpickle.register_pickle_by_value(sys.modules["registry"])

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}

# Fixed choices the checks share.
CHUNK_TOKENS = 512
SMALL_TOKENS = 128
FIRST_ROWS = 100
START_ROW = 150
SOFT_MARK = "ñ"
EMPTY_MARK = "ß"
FLAKY_MARK = "ü"
STREAM_FILE_BYTES = 32 << 20

SMALL_PARAMS = JobParams(max_tokens=CHUNK_TOKENS)


def query(fn: Query) -> Query:
    QUERIES[fn.__name__.rstrip("_")] = fn
    return fn


# -------------------------------------------------------------------- inputs


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def chat_json() -> Column:
    """A turn as a JSON array with one message per line of its text."""
    return F.to_json(
        F.transform(
            F.split("text", "\n"),
            lambda line: F.struct(F.col("role").alias("role"), line.alias("content")),
        )
    )


def chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(turn_id, role, messages): JSON chat cells."""
    turn_id = F.concat_ws("-", "conv_id", "turn")
    return table(spark, sf_dir, "conversations").select(
        turn_id.alias("turn_id"), "role", chat_json().alias("messages")
    )


def mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(turn_id, cell): JSON for the assistant's turns, plain text for all others."""
    turn_id = F.concat_ws("-", "conv_id", "turn")
    cell = F.when(F.col("role") == "assistant", chat_json()).otherwise(F.col("text"))
    return table(spark, sf_dir, "conversations").select(turn_id.alias("turn_id"), cell.alias("cell"))


def noted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents with a nested JSON cell that has protected parts."""
    note = F.struct(
        F.col("doc_id").alias("id"),
        F.col("text").alias("text"),
        F.struct(F.col("text").alias("content"), F.col("source").alias("source")).alias("metadata"),
        F.array(
            F.to_json(F.struct(F.col("lang").alias("summary"), F.col("source").alias("name"))),
        ).alias("raw"),
        F.struct(
            F.struct(F.col("lang").alias("summary"), F.col("source").alias("name")).alias("inner"),
            F.array(F.col("lang")).alias("text"),
        ).alias("notes"),
        F.col("n_chars").alias("n_chars"),
    )
    return documents(spark, sf_dir).select("doc_id", "text", F.to_json(note).alias("note"), "lang")


def gappy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents whose text is null in German, and blank in French."""
    blank = F.regexp_replace("text", r"\S", "")
    cell = F.when(F.col("lang") == "de", F.lit(None).cast("string")).when(
        F.col("lang") == "fr", F.concat(F.lit(" "), blank)
    )
    return documents(spark, sf_dir).select(
        "doc_id", "lang", F.when(cell.isNotNull() | (F.col("lang") == "de"), cell)
        .otherwise(F.col("text")).alias("cell")
    )


def engine(spark: SparkSession, backend=None, params: JobParams = SMALL_PARAMS) -> translate.Engine:
    return translate.make_engine(spark, backend or StubBackend(), params)


# ---------------------------------------------------------- sources and sinks


@query
def read_table(spark, sf_dir):
    return tables.read_table(spark, f"{sf_dir}/orders.parquet")


@query
def load_split(spark, sf_dir):
    work = WorkFolder(spark)
    lake.write_splits(documents(spark, sf_dir), work.root, "web/docs", "lang")
    return lake.load_split(spark, work.root, "web/docs", "en").select(
        "doc_id", "text", "source", "n_chars"
    )


@query
def load_split_limit(spark, sf_dir):
    """The first rows of a split that was cut from a numbered table."""
    work = WorkFolder(spark)
    df = documents(spark, sf_dir).withColumnRenamed("doc_id", "row_id")
    lake.write_splits(df, work.root, "web/docs", "lang")
    return lake.load_split(spark, work.root, "web/docs", "de", FIRST_ROWS).select(
        "row_id", "text", "source", "n_chars"
    )


@query
def list_splits(spark, sf_dir):
    work = WorkFolder(spark)
    lake.write_splits(
        table(spark, sf_dir, "orders"), work.root, "orders", F.col("o_orderstatus")
    )
    return lake.list_splits(spark, work.root, "orders")


@query
def first_n(spark, sf_dir):
    numbered = rows.assign_row_id(table(spark, sf_dir, "orders"))
    return rows.first_n(numbered, FIRST_ROWS).select(
        rows.ROW_ID, "o_orderkey", "o_orderstatus"
    )


@query
def scan_head(spark, sf_dir):
    return rows.scan_head(documents(spark, sf_dir), FIRST_ROWS)


@query
def rows_from(spark, sf_dir):
    numbered = rows.assign_row_id(documents(spark, sf_dir))
    return rows.rows_from(numbered, START_ROW)


@query
def preview(spark, sf_dir):
    return rows.preview(rows.assign_row_id(documents(spark, sf_dir)), 10)


@query
def assign_row_id(spark, sf_dir):
    return rows.assign_row_id(table(spark, sf_dir, "events")).select(
        rows.ROW_ID, "event_id", "event_type"
    )


def _in_files(spark: SparkSession, df: DataFrame, many: int, by: str) -> DataFrame:
    """The table in so many files, in the order of a column."""
    path = WorkFolder(spark).path("files")
    df.repartitionByRange(many, by).sortWithinPartitions(by).write.parquet(path)
    return spark.read.parquet(path)


@query
def assign_row_id_ranges(spark, sf_dir):
    """Positions over ranges of files, as a table of very many files gets them."""
    events = _in_files(spark, table(spark, sf_dir, "events"), 24, "event_id")
    numbered = rows.assign_row_id(events, small_file_count=0, files_per_scan=8)
    return numbered.select(rows.ROW_ID, "event_id", "event_type")


@query
def scan_head_files(spark, sf_dir):
    return rows.scan_head(_in_files(spark, documents(spark, sf_dir), 40, "doc_id"), FIRST_ROWS)


@query
def empty_like(spark, sf_dir):
    """A table without rows, and what is counted of its columns."""
    empty = rows.empty_like(table(spark, sf_dir, "orders"))
    return profile.column_stats(empty)


@query
def write_roundtrip(spark, sf_dir):
    work = WorkFolder(spark)
    df = noted(spark, sf_dir)
    tables.write_table(df, work.root, "web/docs")
    path = tables.table_path(work.root, "web/docs", "csv")
    return tables.read_table(spark, path, df.schema)


@query
def catalog(spark, sf_dir):
    work = WorkFolder(spark)
    for name in ("nation", "orders", "documents"):
        tables.write_table(table(spark, sf_dir, name), work.root, name, csv=False)
    found = tables.catalog(spark, work.root)
    return found.select("name", F.array_join("columns", ",").alias("columns"), "row_count")


@query
def reslice(spark, sf_dir):
    work = WorkFolder(spark)
    tables.ingest_table(documents(spark, sf_dir), work.root, "docs")
    return tables.reslice_cached(spark, work.root, "docs", FIRST_ROWS)


@query
def publish_(spark, sf_dir):
    work = WorkFolder(spark)
    ok, target = publish.publish(
        spark, documents(spark, sf_dir), work.path("shared"), "web/docs", row_id="doc_id"
    )
    return spark.read.parquet(f"{target}/data").withColumn("ok", F.lit(ok))


# --------------------------------------------------- projections and predicates


@query
def text_columns(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem")
    chosen = cells.select_columns(df, cells.text_columns(df))
    return chosen.groupBy(*chosen.columns).agg(F.count(F.lit(1)).alias("n"))


@query
def cell_text(spark, sf_dir):
    return gappy(spark, sf_dir).select(
        "doc_id", tx.cell_text("cell").alias("cell"), tx.cell_text("doc_id").alias("id_text")
    )


@query
def is_translatable(spark, sf_dir):
    return gappy(spark, sf_dir).select("doc_id", tx.is_translatable("cell").alias("translatable"))


@query
def parse_key_list(spark, sf_dir):
    keys = tx.parse_key_list(F.when(F.col("lang") != "de", F.col("text")))
    return documents(spark, sf_dir).select(
        "doc_id", F.size(keys).alias("n_keys"), F.array_join(keys, "|").alias("keys")
    )


@query
def fits_limit(spark, sf_dir):
    return documents(spark, sf_dir).select(
        "doc_id", tx.fits_limit("text", CHUNK_TOKENS).alias("fits")
    )


# ------------------------------------------------------ aggregates and profile


@query
def row_count(spark, sf_dir):
    return profile.row_count(table(spark, sf_dir, "lineitem"))


@query
def column_stats(spark, sf_dir):
    return profile.column_stats(table(spark, sf_dir, "orders"))


@query
def column_stats_text(spark, sf_dir):
    return profile.column_stats(gappy(spark, sf_dir))


@query
def sketch_counts(spark, sf_dir):
    """Counts merged from four batches: equal to those of one sketch of all rows, and near
    the exact ones."""
    df = documents(spark, sf_dir)
    root = WorkFolder(spark).path("sketches")
    for rest in range(4):
        batch = df.where(F.col("doc_id") % 4 == rest)
        sketches.store_sketches(sketches.column_sketches(batch), root, str(rest))
    grown = sketches.sketched_stats(sketches.stored_sketches(spark, root))
    once = sketches.sketched_stats(sketches.column_sketches(df)).select(
        "column", F.col("distinct_values").alias("once")
    )
    exact = profile.column_stats(df).select("column", F.col("distinct_values").alias("exact"))
    off = F.abs(F.col("distinct_values") - F.col("exact"))
    return grown.join(once, "column").join(exact, "column").select(
        "position", "column", "type", "non_null",
        (F.col("distinct_values") == F.col("once")).alias("same"),
        (off <= 4 * F.col("error") * F.col("exact") + 1).alias("within"),
    )


@query
def sketch_job(spark, sf_dir):
    """Counts of a translated table that the job kept as it wrote its batches."""
    job = dataset.Job("web/docs", "train", ("lang",), SMALL_PARAMS)
    run = engine(spark)
    root = run.work.path("out")
    df = documents(spark, sf_dir)
    more = {"row_id": "doc_id", "batch_rows": df.count() // 3 + 1, "sketch": True}
    dataset.translate_dataset(df, job, run, root, max_batches=1, **more)
    dataset.translate_dataset(df, job, run, root, **more)
    kept = dataset.output_stats(spark, root, job)
    written = dataset.read_output(spark, root, job, row_id="none")
    exact = profile.column_stats(written).select("column", F.col("distinct_values").alias("exact"))
    off = F.abs(F.col("distinct_values") - F.col("exact"))
    return kept.join(exact, "column").select(
        "column", "type", "non_null",
        (off <= 4 * F.col("error") * F.col("exact") + 1).alias("within"),
    )


@query
def json_profile(spark, sf_dir):
    return profile.json_profile(table(spark, sf_dir, "events"))


@query
def json_profile_mixed(spark, sf_dir):
    return profile.json_profile(mixed(spark, sf_dir), ["cell"])


@query
def json_keys(spark, sf_dir):
    df = noted(spark, sf_dir)
    found = profile.json_key_table(df)
    events = profile.json_key_table(table(spark, sf_dir, "events"))
    return found.unionByName(events)


@query
def classify_keys(spark, sf_dir):
    return profile.classify_keys(profile.json_key_table(noted(spark, sf_dir)))


@query
def column_report(spark, sf_dir):
    return profile.column_report(noted(spark, sf_dir))


@query
def dataset_card(spark, sf_dir):
    card = profile.dataset_card(
        table(spark, sf_dir, "orders"), "orders-tr", "orders", row_id="o_orderkey"
    )
    return spark.createDataFrame(list(enumerate(card.split("\n"))), "line_no int, line string")


@query
def column_report_many_keys(spark, sf_dir):
    """A column of documents that have as many keys as there are orders."""
    key = F.concat(F.lit("k"), "o_orderkey")
    orders = table(spark, sf_dir, "orders")
    return profile.column_report(orders.select(F.to_json(F.create_map(key, F.lit(1))).alias("cell")))


@query
def publish_card(spark, sf_dir):
    """The card of a published table, read back from its file."""
    work = WorkFolder(spark)
    df = table(spark, sf_dir, "orders")
    card = profile.dataset_card(df, "orders-tr", "orders", row_id="o_orderkey")
    path = publish.publish_card(spark, card, work.path("shared"))
    text = spark.read.text(path, wholetext=True)
    return text.select(F.posexplode(F.split("value", "\n")).alias("line_no", "line"))


def _order_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as rows of five jobs, one per priority; finished orders are done."""
    orders = table(spark, sf_dir, "orders")
    done = orders.where(F.col("o_orderstatus") == "F")
    return jobs.job_states(
        orders, done, ["o_orderpriority"], "o_orderkey", F.col("o_orderdate")
    )


def _document_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as rows of one job per source; labelled documents are done."""
    docs = documents(spark, sf_dir)
    done = docs.join(table(spark, sf_dir, "labels"), "doc_id", "left_semi")
    return jobs.job_states(docs, done, ["source"], "doc_id").drop("updated_at")


@query
def job_state(spark, sf_dir):
    return _order_jobs(spark, sf_dir)


@query
def job_state_documents(spark, sf_dir):
    return _document_jobs(spark, sf_dir)


@query
def has_pending(spark, sf_dir):
    return jobs.with_pending(_document_jobs(spark, sf_dir)).select("source", "has_pending")


@query
def pending_jobs(spark, sf_dir):
    return jobs.pending_jobs(_document_jobs(spark, sf_dir))


@query
def latest_pending(spark, sf_dir):
    saved = table(spark, sf_dir, "orders").select("o_orderpriority")
    return jobs.latest_pending(_order_jobs(spark, sf_dir), ["o_orderpriority"], saved)


@query
def progress_ratio(spark, sf_dir):
    return jobs.with_progress(_document_jobs(spark, sf_dir)).select("source", "progress", "status")


@query
def job_summary(spark, sf_dir):
    states = _document_jobs(spark, sf_dir)
    return jobs.job_summary(
        states, F.lit("documents"), F.col("source"), ["text"], "en", "tr"
    ).select("source", "summary")


@query
def resume_remaining(spark, sf_dir):
    return jobs.remaining(
        documents(spark, sf_dir), table(spark, sf_dir, "labels"), "doc_id"
    ).select("doc_id", "text", "lang")


@query
def start_override(spark, sf_dir):
    """Translated, then once more from a row on, of a table that has changed."""
    job = dataset.Job("web/docs", "train", ("text",), SMALL_PARAMS)
    run = engine(spark)
    root = run.work.path("out")
    df = documents(spark, sf_dir).select("doc_id", "text")
    dataset.translate_dataset(df, job, run, root, "doc_id")
    changed = df.withColumn("text", F.concat(F.lit("new "), "text"))
    dataset.translate_dataset(changed, job, run, root, "doc_id", start_row=START_ROW)
    return spark.read.parquet(dataset.output_path(root, job)).drop(translate.FAILED)


@query
def restart(spark, sf_dir):
    """Translated, forgotten, and translated again from a table that has changed."""
    job = dataset.Job("web/docs", "train", ("text",), SMALL_PARAMS)
    run = engine(spark)
    root = run.work.path("out")
    df = documents(spark, sf_dir).select("doc_id", "text")
    dataset.translate_dataset(df, job, run, root, "doc_id")
    dataset.restart(spark, root, job)
    changed = df.withColumn("text", F.concat(F.lit("new "), "text"))
    dataset.translate_dataset(changed, job, run, root, "doc_id")
    return spark.read.parquet(dataset.output_path(root, job)).drop(translate.FAILED)


@query
def find_pending(spark, sf_dir):
    """Jobs found from their output folder alone: one is half done, one is finished."""
    run = engine(spark)
    root = run.work.path("out")
    df = documents(spark, sf_dir)
    half = df.agg(F.max("doc_id")).first()[0] // 2 + 1
    more = {"row_id": "doc_id", "batch_rows": half}
    begun = dataset.Job("web/docs", "train", ("source",), SMALL_PARAMS)
    dataset.translate_dataset(df, begun, run, root, max_batches=1, **more)
    done = dataset.Job("web/docs", "train", ("lang",), SMALL_PARAMS)
    dataset.translate_dataset(df, done, run, root, **more)
    states = jobs.with_progress(jobs.with_pending(dataset.found_states(spark, root)))
    return states.select(
        "dataset_id", "split", F.array_join("columns", ",").alias("columns"), "total_rows",
        "completed_rows", "has_pending", "status",
    )


@query
def import_states(spark, sf_dir):
    """Records of jobs, one for each priority of orders; one of them is broken."""
    path = WorkFolder(spark).path("records")
    record = F.to_json(
        F.struct(
            F.col("o_orderpriority").alias("dataset_id"), F.array(F.lit("text")).alias("columns"),
            F.count("*").alias("total_rows"),
            F.count_if(F.col("o_orderstatus") == "F").alias("completed_rows"),
        )
    )
    found = table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(record.alias("value"))
    broken = F.when(F.col("o_orderpriority") == "5-LOW", F.lit("{not JSON")).otherwise(F.col("value"))
    found.withColumn("value", broken).write.partitionBy("o_orderpriority").text(path)
    states = jobs.import_states(spark, path)
    return states.select(
        "dataset_id", "split", F.array_join("columns", ",").alias("columns"), "total_rows",
        "completed_rows", "last_saved_row",
    )


def sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with ids around 2^60 that have gaps."""
    far = F.lit(1 << 60) + F.col("doc_id") * F.col("doc_id") * 7
    return documents(spark, sf_dir).select(far.alias("id"), "doc_id", "text")


@query
def translate_sparse_ids(spark, sf_dir):
    """Ids with gaps in batches by count, stopped after one batch and finished."""
    job = dataset.Job("web/sparse", "train", ("text",), SMALL_PARAMS)
    run = engine(spark)
    root = run.work.path("out")
    df = sparse(spark, sf_dir)
    more = {"row_id": "id", "batch_rows": df.count() // 2 + 1}
    dataset.translate_dataset(df, job, run, root, max_batches=1, **more)
    dataset.translate_dataset(df, job, run, root, **more)
    return spark.read.parquet(dataset.output_path(root, job)).drop(translate.FAILED)


@query
def translate_stopped(spark, sf_dir):
    """Stopped after the first commit of results, then finished."""
    job = dataset.Job("web/docs", "train", ("text",), SMALL_PARAMS)
    run = replace(engine(spark), commit_chunks=500, max_requests=4)
    root = run.work.path("out")
    df = documents(spark, sf_dir)
    asked: list[int] = []

    def stop() -> bool:
        asked.append(1)
        return len(asked) > 2

    dataset.translate_dataset(df, job, run, root, "doc_id", should_stop=stop)
    dataset.translate_dataset(df, job, run, root, "doc_id")
    return spark.read.parquet(dataset.output_path(root, job)).drop(translate.FAILED)


def repeating(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns under the id of their conversation, so ids repeat; every fifth one has none."""
    row = F.when(F.col("conv_id") % 5 != 0, F.col("conv_id"))
    return table(spark, sf_dir, "conversations").select(row.alias("row"), "turn", "role", "text")


@query
def translate_repeated_ids(spark, sf_dir):
    return translate.translate_rows(repeating(spark, sf_dir), ["text", "role"], engine(spark), "row")


@query
def translate_plain_repeated_ids(spark, sf_dir):
    return translate.translate_plain(repeating(spark, sf_dir), "text", engine(spark), "row")


@query
def translation_pairs_repeated_ids(spark, sf_dir):
    return translate.translation_pairs(repeating(spark, sf_dir), ["text"], engine(spark), "row")


@query
def translate_dataset_repeated_ids(spark, sf_dir):
    """In batches, stopped after the first and finished, with columns of any name."""
    job = dataset.Job("web/turns", "train", ("text",), SMALL_PARAMS)
    run = engine(spark)
    root = run.work.path("out")
    df = repeating(spark, sf_dir).withColumnsRenamed({"turn": "_key", "role": "_found_0"})
    more = {"row_id": "row", "batch_rows": df.count() // 3 + 1}
    dataset.translate_dataset(df, job, run, root, max_batches=1, **more)
    dataset.translate_dataset(df, job, run, root, **more)
    return spark.read.parquet(dataset.output_path(root, job)).drop(translate.FAILED)


@query
def translate_stopped_within(spark, sf_dir):
    """Stopped from another thread in the middle of a commit, then finished."""
    job = dataset.Job("web/docs", "train", ("text",), SMALL_PARAMS)
    run = engine(spark, SlowBackend(0.02))
    root = run.work.path("out")
    df = documents(spark, sf_dir)
    handle = control.Control(spark)

    def stop_soon(done: int, total: int) -> None:
        if total:
            handle.stop()

    dataset.translate_dataset(df, job, run, root, "doc_id", control=handle, on_tasks=stop_soon)
    run = replace(run, backend=StubBackend())
    dataset.translate_dataset(df, job, run, root, "doc_id")
    return spark.read.parquet(dataset.output_path(root, job)).drop(translate.FAILED)


@query
def error_state(spark, sf_dir):
    """Jobs found from their folder alone: one whose backend broke down, one that ended."""
    run = engine(spark)
    root = run.work.path("out")
    df = documents(spark, sf_dir)
    broken = replace(run, backend=FaultyBackend(fatal="a"))
    begun = dataset.Job("web/docs", "train", ("text",), SMALL_PARAMS)
    try:
        dataset.translate_dataset(df, begun, broken, root, "doc_id")
    except Exception:  # what the cluster makes of it; the log has the reason
        pass
    done = dataset.Job("web/docs", "train", ("lang",), SMALL_PARAMS)
    dataset.translate_dataset(df, done, run, root, "doc_id")
    return dataset.listed_jobs(spark, root).select(
        F.array_join("columns", ",").alias("columns"), "total_rows", "completed_rows", "status",
        "message",
    )


@query
def job_parameters(spark, sf_dir):
    """What a job's parameters change: prompt, languages, keys and the limit of a chunk."""
    params = JobParams(
        "de", "fr", max_tokens=SMALL_TOKENS, message_template="{src}>{tgt}: {text}",
        system_prompt="", translate_keys=("role",), skip_keys=(),
    )
    run = engine(spark, LastBackend(), params)
    both = chats(spark, sf_dir).select("turn_id", F.col("messages").alias("cell"))
    return translate.translation_pairs(both, ["cell"], run, "turn_id")


@query
def two_results(spark, sf_dir):
    """Two results of one engine, of which the first is read last."""
    run = engine(spark)
    df = documents(spark, sf_dir)
    texts = translate.translate_plain(df, "text", run, "doc_id")
    langs = translate.translate_plain(df, "lang", run, "doc_id")
    said = langs.select("doc_id", F.col("translation").alias("lang"))
    return said.join(texts, "doc_id")


# ------------------------------------------------------- text and chunking


@query
def estimate_tokens(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select(
        F.concat(F.lit("page-"), "page_id").alias("id"), F.col("html").alias("cell")
    )
    docs = gappy(spark, sf_dir).select(F.concat(F.lit("doc-"), "doc_id").alias("id"), "cell")
    return pages.unionByName(docs).select("id", tx.estimate_tokens("cell").alias("tokens"))


@query
def split_boundaries(spark, sf_dir):
    return documents(spark, sf_dir).select(
        "doc_id", F.posexplode_outer(tx.split_boundaries("text")).alias("pos", "part")
    )


@query
def pack_chunks(spark, sf_dir):
    packed = tx.pack_chunks(tx.split_boundaries("text"), CHUNK_TOKENS)
    return documents(spark, sf_dir).select(
        "doc_id", F.posexplode_outer(packed).alias("pos", "chunk")
    )


@query
def chunk_table(spark, sf_dir):
    df = documents(spark, sf_dir).select("doc_id", "text")
    return chunks.chunk_table(df, "text", CHUNK_TOKENS)


@query
def chunk_deep(spark, sf_dir):
    df = documents(spark, sf_dir).select("doc_id", "text")
    return chunks.chunk_table(df, "text", SMALL_TOKENS)


@query
def chunk_pages(spark, sf_dir):
    df = table(spark, sf_dir, "pages").select("page_id", "html")
    return chunks.chunk_table(df, "html", CHUNK_TOKENS)


@query
def join_chunks(spark, sf_dir):
    df = documents(spark, sf_dir).select("doc_id", "text")
    pieces = chunks.chunk_table(df, "text", CHUNK_TOKENS)
    return chunks.join_chunks(pieces, ["doc_id"], "chunk")


def _prompts(spark: SparkSession, sf_dir: str, preset: str) -> DataFrame:
    system_prompt, template = PROMPT_PRESETS[preset]
    messages = tx.render_prompt("text", "en", "tr", system_prompt, template)
    return (
        documents(spark, sf_dir)
        .select("doc_id", F.posexplode_outer(messages).alias("pos", "m"))
        .select("doc_id", "pos", "m.role", "m.content")
    )


@query
def render_prompt(spark, sf_dir):
    return _prompts(spark, sf_dir, "general")


@query
def render_prompt_translation_model(spark, sf_dir):
    return _prompts(spark, sf_dir, "translation_model")


def _sent(spark: SparkSession, sf_dir: str, preset: str) -> DataFrame:
    """The messages a backend gets for each document, as it tells them."""
    system_prompt, template = PROMPT_PRESETS[preset]
    params = JobParams(system_prompt=system_prompt, message_template=template)
    df = documents(spark, sf_dir).select("doc_id", F.col("text").alias("chunk"))
    told = inference.translate_chunks(df, TellingBackend(), params)
    sent = F.from_json("tgt", "array<struct<role: string, content: string>>")
    return told.select("doc_id", F.posexplode(sent).alias("pos", "m")).select(
        "doc_id", "pos", "m.role", "m.content"
    )


@query
def prompt_sent(spark, sf_dir):
    return _sent(spark, sf_dir, "general")


@query
def prompt_sent_translation_model(spark, sf_dir):
    return _sent(spark, sf_dir, "translation_model")


def _any_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON, plain, blank and null cells, and JSON numbers, from four tables."""
    events = table(spark, sf_dir, "events").select(
        F.concat(F.lit("event-"), "event_id").alias("id"), F.col("props").alias("cell")
    )
    users = table(spark, sf_dir, "events").select(
        F.concat(F.lit("user-"), "event_id").alias("id"), F.col("user_id").cast("string").alias("cell")
    )
    turns = mixed(spark, sf_dir).select(F.concat(F.lit("turn-"), "turn_id").alias("id"), "cell")
    broken = mixed(spark, sf_dir).select(
        F.concat(F.lit("broken-"), "turn_id").alias("id"), F.concat("cell", F.lit(" x")).alias("cell")
    )
    docs = gappy(spark, sf_dir).select(F.concat(F.lit("doc-"), "doc_id").alias("id"), "cell")
    return events.unionByName(users).unionByName(turns).unionByName(broken).unionByName(docs)


@query
def is_json_cell(spark, sf_dir):
    return _any_cells(spark, sf_dir).select("id", jsoncell.is_json_cell("cell").alias("is_json"))


@query
def cell_kind(spark, sf_dir):
    return _any_cells(spark, sf_dir).select("id", jsoncell.json_kind("cell").alias("kind"))


@query
def route_cell(spark, sf_dir):
    return _any_cells(spark, sf_dir).select(
        "id",
        cells.route_cell(F.col("cell")).alias("auto"),
        cells.route_cell(F.col("cell"), "force").alias("force"),
        cells.route_cell(F.col("cell"), "off").alias("off"),
    )


@query
def job_key(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", tx.job_key("source", "lang").alias("key"))


@query
def safe_name(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", tx.safe_name("url").alias("name"))


# --------------------------------------------------------------------- JSON


@query
def json_leaves(spark, sf_dir):
    df = chats(spark, sf_dir).select("turn_id", "messages")
    return leaves.explode_json_leaves(df, "messages")


@query
def json_leaves_skip(spark, sf_dir):
    df = chats(spark, sf_dir).select("turn_id", "messages")
    return leaves.explode_json_leaves(
        df, "messages", translate_keys=("role", "content"), skip_keys=("content",)
    )


@query
def json_leaves_nested(spark, sf_dir):
    return leaves.explode_json_leaves(noted(spark, sf_dir).select("doc_id", "note"), "note")


@query
def json_rebuild(spark, sf_dir):
    pieces = F.transform(
        jsoncell.json_leaves("messages"),
        lambda leaf: F.struct(
            leaf["leaf_ord"].alias("leaf_ord"), F.concat(F.lit("[tr] "), leaf["text"]).alias("tgt")
        ),
    )
    df = chats(spark, sf_dir).withColumn("pieces", pieces)
    return df.select("turn_id", jsoncell.json_rebuild("messages", F.col("pieces")).alias("messages"))


@query
def leaf_table(spark, sf_dir):
    return leaves.leaf_table(mixed(spark, sf_dir))


@query
def unpivot_cells(spark, sf_dir):
    return cells.unpivot_cells(
        table(spark, sf_dir, "orders"),
        "o_orderkey",
        ["o_orderstatus", "o_orderpriority", "o_custkey", "o_totalprice"],
    )


# --------------------------------------------------------------- translation


@query
def dedupe_chunks(spark, sf_dir):
    df = documents(spark, sf_dir).select("text")
    pieces = chunks.chunk_table(df, "text", CHUNK_TOKENS)
    keyed = pieces.withColumn("key", inference.chunk_key("chunk", SMALL_PARAMS))
    return inference.dedupe_chunks(keyed).select("chunk")


@query
def translate_chunks(spark, sf_dir):
    df = table(spark, sf_dir, "benchmark")
    pieces = chunks.chunk_table(df, "text", SMALL_TOKENS).drop("est_tokens")
    return inference.translate_chunks(pieces, StubBackend(), SMALL_PARAMS)


FAULTY = FaultyBackend(soft=SOFT_MARK, empty=EMPTY_MARK, flaky=FLAKY_MARK)
FAULT_PARAMS = JobParams(max_tokens=CHUNK_TOKENS, retry_wait=0.0)


@query
def translate_status(spark, sf_dir):
    df = documents(spark, sf_dir).select("doc_id", "text")
    pieces = chunks.chunk_table(df, "text", CHUNK_TOKENS).drop("est_tokens")
    done = inference.translate_chunks(pieces, FAULTY, FAULT_PARAMS, in_flight=4)
    return done.select("doc_id", "chunk_idx", "tgt", "status")


@query
def fallback_original(spark, sf_dir):
    df = documents(spark, sf_dir).select("doc_id", "text")
    return translate.translate_rows(df, ["text"], engine(spark, FAULTY, FAULT_PARAMS), "doc_id")


@query
def translation_memory(spark, sf_dir):
    """What a second run finds in the memory: everything, so nothing is left to do."""
    run = engine(spark)
    df = documents(spark, sf_dir).select("doc_id", "text")
    keyed = chunks.chunk_table(df, "text", CHUNK_TOKENS).withColumn(
        "key", inference.chunk_key("chunk", run.params)
    )
    todo = run.memory.missing(keyed, run.params)
    run.memory.append(inference.translate_chunks(todo, run.backend, run.params), run.params)
    left_over = run.memory.missing(keyed, run.params).count()
    return run.memory.rows().agg(
        F.count(F.lit(1)).alias("stored"),
        F.sum(F.length("tgt").cast("long")).alias("stored_chars"),
        F.lit(left_over).cast("long").alias("left_over"),
    )


@query
def memory_files(spark, sf_dir):
    """Chunks stored in ten commits, and one commit's chunks looked up again: each with its
    translation, and whether few files were opened for that."""
    run = engine(spark)
    memory = inference.TranslationMemory(spark, run.work.path("many"), min_files=5)
    keyed = chunks.chunk_table(documents(spark, sf_dir).select("doc_id", "text"), "text", CHUNK_TOKENS)
    keyed = run.work.write(keyed.withColumn("key", inference.chunk_key("chunk", run.params)), "keyed")
    for rest in range(10):
        part = memory.missing(keyed.where(F.col("doc_id") % 10 == rest), run.params).coalesce(1)
        memory.append(inference.translate_chunks(part, run.backend, run.params), run.params)
    again = inference.dedupe_chunks(keyed.where(F.col("doc_id") % 10 == 7))
    opened = memory.opened(again.select("key")).select(F.col("_metadata.file_path")).distinct()
    every = memory.rows().select(F.col("_metadata.file_path")).distinct()
    few = opened.count() < every.count()
    found = again.join(memory.known(run.params, again.select("key")), "key")
    return found.select("chunk", "tgt", F.lit(few).alias("few_files"))


@query
def translate_plain(spark, sf_dir):
    df = documents(spark, sf_dir).select("doc_id", "text")
    return translate.translate_plain(df, "text", engine(spark), "doc_id")


@query
def translate_json(spark, sf_dir):
    return translate.translate_rows(
        chats(spark, sf_dir), ["messages"], engine(spark), "turn_id"
    )


@query
def translate_column(spark, sf_dir):
    return translate.translate_rows(mixed(spark, sf_dir), ["cell"], engine(spark), "turn_id")


@query
def translate_blank(spark, sf_dir):
    return translate.translate_rows(gappy(spark, sf_dir), ["cell"], engine(spark), "doc_id")


@query
def translate_dataset(spark, sf_dir):
    """All of it: two columns, one of them JSON, committed in batches."""
    job = dataset.Job("web/docs", "train", ("text", "note"), SMALL_PARAMS)
    run = engine(spark)
    df = noted(spark, sf_dir)
    root = run.work.path("out")
    dataset.translate_dataset(df, job, run, root, row_id="doc_id")
    return spark.read.parquet(dataset.output_path(root, job)).drop(translate.FAILED)


@query
def translate_resumed(spark, sf_dir):
    """Stopped after one batch, then finished."""
    job = dataset.Job("web/docs", "train", ("text",), SMALL_PARAMS)
    run = engine(spark)
    df = documents(spark, sf_dir)
    root = run.work.path("out")
    half = df.agg(F.max("doc_id")).first()[0] // 2 + 1
    more = {"row_id": "doc_id", "batch_rows": half}
    dataset.translate_dataset(df, job, run, root, max_batches=1, **more)
    dataset.translate_dataset(df, job, run, root, **more)
    return spark.read.parquet(dataset.output_path(root, job)).drop(translate.FAILED)


@query
def translate_stream_files(spark, sf_dir):
    """The same through a stream that takes the files as they are."""
    job = dataset.Job("web/docs", "stream", ("text",), SMALL_PARAMS)
    run = engine(spark)
    root = run.work.path("out")
    source = run.work.path("in")
    df = documents(spark, sf_dir)
    df.repartition(4, "doc_id").write.parquet(source)
    stream = translate_stream(
        spark, source, df.schema, job, run, root, run.work.path("log"), "doc_id", max_files=2
    )
    stream.awaitTermination()
    return spark.read.parquet(dataset.output_path(root, job)).drop(translate.FAILED)


def _streamed(
    spark: SparkSession, sf_dir: str, run: translate.Engine, file_bytes: int = STREAM_FILE_BYTES
) -> tuple[str, DataFrame, int]:
    """Documents in four parts, by the remainder of their id, the oldest with remainder 0.

    Also the files of a part: one, and more for a table of more than four times
    ``file_bytes``, so that no task writes more than that.
    """
    source = run.work.path("in")
    df = documents(spark, sf_dir)
    names = df.inputFiles()
    fs = FileSystem(spark, names[0])
    many = max(1, -(-sum(fs.size(name) for name in names) // (4 * file_bytes)))
    for rest in range(4):
        part = df.where(F.col("doc_id") % 4 == rest)
        part = part.repartition(many) if many > 1 else part.coalesce(1)
        part.write.mode("append").parquet(source)
    return source, df, many


@query
def stream_repeated_batch(spark, sf_dir):
    """Micro-batches that are given twice, the second time to a backend that cannot answer."""
    job = dataset.Job("web/docs", "stream", ("text",), SMALL_PARAMS)
    run = engine(spark)
    root = run.work.path("out")
    df = documents(spark, sf_dir)
    broken = replace(run, backend=FaultyBackend(fatal=""), memory=engine(spark).memory)
    for use in (run, broken):
        for rest in (0, 1):
            batch = df.where(F.col("doc_id") % 2 == rest)
            incremental.commit_batch(batch, f"stream-{rest}", job, use, root, "doc_id")
    return spark.read.parquet(dataset.output_path(root, job)).drop(translate.FAILED)


@query
def stream_stopped(spark, sf_dir):
    """A stream that is stopped within a micro-batch, and taken up by the next query."""
    job = dataset.Job("web/docs", "stream", ("text",), SMALL_PARAMS)
    run = engine(spark, SlowBackend(0.02))
    root, log = run.work.path("out"), run.work.path("log")
    source, df, files = _streamed(spark, sf_dir, run)
    handle = control.Control(spark)
    stream = incremental.translate_stream(
        spark, source, df.schema, job, run, root, log, "doc_id", max_files=2 * files, control=handle
    )
    while stream.isActive and not handle.tasks()[1]:
        stream.awaitTermination(0.2)
    handle.stop()
    control.finished(stream, handle)
    rest = incremental.translate_stream(
        spark, source, df.schema, job, replace(run, backend=StubBackend()), root, log, "doc_id"
    )
    rest.awaitTermination()
    return spark.read.parquet(dataset.output_path(root, job)).drop(translate.FAILED)


@query
def stream_progress(spark, sf_dir):
    """Rows read, rows written and failed chunks of each micro-batch."""
    job = dataset.Job("web/docs", "stream", ("text",), FAULT_PARAMS)
    run = engine(spark, FAULTY, FAULT_PARAMS)
    root = run.work.path("out")
    source, df, files = _streamed(spark, sf_dir, run)
    seen = incremental.StreamProgress()
    spark.streams.addListener(seen)
    try:
        stream = incremental.translate_stream(
            spark, source, df.schema, job, run, root, run.work.path("log"), "doc_id",
            max_files=2 * files,
        )
        seen.query_id = str(stream.id)
        stream.awaitTermination()
        seen.ended.wait(60)
    finally:
        spark.streams.removeListener(seen)
    followed = F.col("batch").isin(list(seen.milliseconds))
    found = runs.commits(spark, root, job.key).where(followed)
    return found.select("batch", "rows_read", "rows", "failed_chunks")


@query
def translation_pairs(spark, sf_dir):
    return translate.translation_pairs(
        mixed(spark, sf_dir), ["cell"], engine(spark), "turn_id"
    )


@query
def observe_metrics(spark, sf_dir):
    """Rows and failed chunks, counted while the result is written."""
    run = engine(spark, FAULTY, FAULT_PARAMS)
    df = documents(spark, sf_dir).select("doc_id", "text")
    counted = dataset.append_batch(df, ["text"], run, run.work.path("out"), "doc_id")
    return spark.createDataFrame(
        [(counted["rows"], counted[translate.FAILED])], "rows long, failed_chunks long"
    )


@query
def canary(spark, sf_dir):
    """Rows a job wrote, with a backend that works and one that cannot translate a word."""
    job = dataset.Job("web/docs", "train", ("lang",), SMALL_PARAMS)
    df = documents(spark, sf_dir).select("doc_id", "lang")
    found = []
    for name, backend in (("working", StubBackend()), ("failing", FaultyBackend(soft="Hello"))):
        run = engine(spark, backend)
        root = run.work.path("out")
        try:
            dataset.translate_dataset(df, job, run, root, "doc_id")
        except FatalBackendError:
            pass
        path = dataset.output_path(root, job)
        rows = dataset.stored_output(spark, path, df, job.columns)
        found.append(rows.agg(F.lit(name).alias("backend"), F.count("*").alias("written")))
    return found[0].union(found[1])
