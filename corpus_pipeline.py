"""A corpus from raw documents to packed sequences, in stages that are written and reread.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept. All but
the last return the columns of ``documents``:

language     documents without a language (``und``) go; ``lang`` of the others stays
near_copies  of the documents whose fingerprints of three-word shingles are linked within
             three bits, the smallest doc_id stays
secrets      secrets are cut out of the texts, ``n_chars`` follows
mixture      sources are brought to their target weights; a row stands for each epoch
packing      pieces of at most 1024 tokens and their places in the packed sequences

Null texts, ids and sources are handled as the operators say; an empty table passes
through all stages.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from glossa.llm import language_mix, mixing, packing, secret_scan, simhash
from glossa.llm.common import table, work

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
CAPACITY = 1024


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that have a language; the model learns from the labelled rows among them.

    If none is labelled, documents without a letter go.
    """
    model = language_mix.learn(docs)
    if not model.languages:
        return docs.select(*COLUMNS).filter(F.col("text").rlike(r"\p{L}"))
    found = language_mix.predict(docs.select(*COLUMNS), model)
    return found.filter(F.col("lang_pred") != language_mix.UNKNOWN).select(*COLUMNS)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies.

    Rows equal in doc_id are one document: all of them stay if the id stays. So do rows
    without an id, unless each is a copy of a document that has one.
    """
    groups = simhash.near_duplicates(docs, shingle=3, radius=3)
    kept = groups.filter(F.col("doc_id").eqNullSafe(F.col("component_id")))
    first = kept.select(F.col("doc_id").alias("_kept")).distinct()
    return docs.join(first, docs["doc_id"].eqNullSafe(first["_kept"]), "left_semi").select(*COLUMNS)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the secrets in them."""
    found = secret_scan.scan(docs.select(*COLUMNS))
    clean = found.withColumn("text", secret_scan.redacted(F.col("text"), F.col("secrets")))
    length = F.when(F.size("secrets") > 0, F.length("text")).otherwise(F.col("n_chars"))
    return clean.withColumn("n_chars", length.cast("long")).select(*COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Weights 5, 2, 1 in turn by source, 150 % of all words, at most two epochs of each."""
    return mixing.repeated(mixing.mix(docs.select(*COLUMNS)))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces and their places: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    cut = packing.pieces(docs, path, end_id=2, capacity=CAPACITY)
    cut = work(spark).write(packing.with_crc(cut).drop("ids"), "pieces")
    return packing.pack(cut, CAPACITY, ("doc_id", "piece", "start", "ids_crc32"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("near_copies", near_copies),
    ("secrets", secrets),
    ("mixture", mixture),
    ("packing", packed),
]

#: Language inference and fingerprints have no SQL form; tests hold the stages against
#: plain Python on small tables.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn, each written as Parquet below the shared folder and reread."""
    folder = work(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = folder.write(stage(spark, docs, sf_dir), name)
    return docs
