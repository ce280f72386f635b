"""The queries of this subpackage, and DuckDB's SQL for those that SQL expresses."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from glossa.llm import (
    importance, language_mix, learned_index, line_dedup, mixing, packing, quality_rules, secret_scan,
    simhash, substrings, token_files, voronoi, whitening,
)
from glossa.llm.common import table, work

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents: weights 5, 2, 1 in turn, 150 % of all words, 2 epochs."""
    mixed = mixing.mix(
        table(spark, sf_dir, "documents"), weights=(5, 2, 1), share=1.5, max_epochs=2.0
    )
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


ORACLES["op1_mix_sources"] = r"""
WITH docs AS (
    SELECT doc_id, source,
        coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
        ('0x' || substr(md5('7:' || coalesce(doc_id::VARCHAR, 'null:' || md5(coalesce(text, '')))), 1, 8)
        )::BIGINT AS digest
    FROM documents
), sizes AS (
    SELECT source, sum(size)::BIGINT AS source_size,
        [5.0, 2.0, 1.0][
            ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INTEGER]::DOUBLE AS w
    FROM docs GROUP BY source
), levels AS (
    SELECT *, 2.0::DOUBLE * source_size AS cap,
        (1.5::DOUBLE * sum(source_size) OVER ()
            - coalesce(sum(2.0::DOUBLE * source_size) OVER before, 0)) / sum(w) OVER after AS level
    FROM sizes
    WINDOW before AS (ORDER BY 2.0::DOUBLE * source_size / w, source
                      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
           after AS (ORDER BY 2.0::DOUBLE * source_size / w, source
                     ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
), found AS (
    SELECT arg_min(level, cap / w) FILTER (cap >= level * w) AS level FROM levels
), targets AS (
    SELECT l.source, l.source_size, least(cap, coalesce(f.level * w, cap)) AS target,
        CASE WHEN l.source_size > 0 THEN target / l.source_size ELSE 0 END AS epochs
    FROM levels l, found f
), runs AS (
    SELECT d.*, t.source_size, t.target, floor(t.epochs)::BIGINT AS whole,
        sum(size) OVER (PARTITION BY d.source ORDER BY digest, doc_id, size
                        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size / 2.0 AS middle,
        t.target - floor(t.epochs) * t.source_size AS want
    FROM docs d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source
), ends AS (
    SELECT *, max(CASE WHEN middle <= want
                  THEN {'a': digest, 'b': doc_id, 'c': size} END) OVER (PARTITION BY source) AS last
    FROM runs
)
SELECT doc_id, size, source_size, target,
    (size * (whole + CASE WHEN size > 0 AND {'a': digest, 'b': doc_id, 'c': size} <= last
                     THEN 1 ELSE 0 END))::BIGINT AS taken
FROM ends
"""


@query
def op3_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as sequences of at most 1024 tokens."""
    cut = packing.pieces(
        table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"),
        end_id=2, capacity=1024,
    )
    cut = work(spark).write(packing.with_crc(cut).drop("ids"), "pieces")
    packed = packing.pack(cut, 1024, ("doc_id", "piece", "start", "ids_crc32"))
    return packed.withColumn("length", F.col("length").cast("long"))


@query
def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents written as token files and read back."""
    folder = token_files.write_store(
        table(spark, sf_dir, "documents"), work(spark).path("tokens"),
        public_tokenizers.path("word_bpe_49k.json"), end_id=1, id_bytes=2,
    )
    read = packing.with_crc(token_files.read_store(spark, folder))
    return read.select("doc_id", "start", "n_tokens", "ids_crc32")


@query
def op5_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and the groups they form within three bits."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, radius=3)


@query
def op2_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of all documents without passages of 13 words of smaller ids."""
    parsed = substrings.parse(table(spark, sf_dir, "documents"), window=13)
    digest = F.sha2("kept", 256).alias("kept_sha256")
    return parsed.select("doc_id", "n_words", "n_removed", digest)


@query
def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of secrets in all documents."""
    found = secret_scan.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    random = secret_scan.KINDS.index("random")
    base = F.filter("secrets", lambda s: s["kind"] != random)

    def count(number: int) -> Column:
        return F.size(F.filter("secrets", lambda s: s["kind"] == number)).cast("long")

    counts = [count(i).alias(f"n_{kind}") for i, kind in enumerate(secret_scan.KINDS[:random])]
    return found.select(
        "doc_id", *counts, F.sha2(secret_scan.listed(base), 256).alias("base_sha256"),
        secret_scan.listed(F.col("secrets")).alias("spans"),
    )


def hash_class(classes: int) -> Column:
    """crc32 of doc_id as text, by remainders; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % classes


@query
def op4_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of all documents, learned from four fifths of the labelled ones."""
    docs = table(spark, sf_dir, "documents")
    model = language_mix.learn(docs.filter(hash_class(5) != 0))
    held = docs.select("doc_id", "text", (hash_class(5) == 0).alias("held_out"))
    made = language_mix.predict(held, model)
    return made.select("doc_id", "held_out", "lang_pred", "score")


@query
def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality of all documents by weighted rules, learned from three quarters."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").filter(hash_class(4) != 2)
    rules = quality_rules.fit(docs, labels.withColumnRenamed("quality", "label"))
    made = quality_rules.score(docs, rules)
    return made.select(
        "doc_id", (hash_class(4) == 2).alias("held_out"), "score",
        (F.col("score") >= 0.7).cast("int").alias("predicted"),
    )


@query
def op7_voronoi_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 largest inner products of every twentieth embedding, in 64ths rounded down."""

    def floored(x: Column) -> Column:
        """Doubles from 2^53 on are whole numbers, and may be too large for a long."""
        return F.when(F.abs(64 * x) < 2**53, F.floor(64 * x).cast("double")).otherwise(64 * x)

    found = voronoi.top_k(
        table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20, component=floored
    )
    return found.withColumn("score", F.col("score").cast("long"))


ORACLES["op7_voronoi_top_k"] = """
WITH rows AS (
    SELECT vec_id, [floor(64 * x::DOUBLE) FOR x IN embedding] AS v FROM embeddings
    WHERE len(embedding) > 0
        AND len([1 FOR x IN embedding IF x IS NOT NULL AND isfinite(x)]) = len(embedding)
), ranked AS (
    SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score,
        row_number() OVER (
            PARTITION BY q.vec_id ORDER BY list_dot_product(q.v, c.v) DESC, c.vec_id
        )::INTEGER AS rank
    FROM rows q JOIN rows c ON q.vec_id <> c.vec_id
    WHERE q.vec_id % 20 = 0
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""


@query
def op8_learned_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 nearest found of every fiftieth embedding, by cosine."""
    return learned_index.search(
        table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5
    )


@query
def op11_repeated_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of all documents without lines that ten or more of them hold."""
    made = line_dedup.drop_repeated_lines(
        table(spark, sf_dir, "documents"), min_documents=10, min_chars=1
    )
    return made.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


ORACLES["op11_repeated_lines"] = r"""
WITH docs AS (
    SELECT row_number() OVER () AS row, doc_id, string_split(coalesce(text, ''), chr(10)) AS cut
    FROM documents
), lines AS (
    SELECT row, doc_id, unnest(cut) AS line, unnest(range(len(cut))) AS pos FROM docs
), keyed AS (
    SELECT *, translate(trim(line, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
    FROM lines
), frequent AS (
    SELECT key FROM keyed WHERE length(key) >= 1
    GROUP BY key HAVING count(DISTINCT coalesce(doc_id::VARCHAR, 'none')) >= 10
)
SELECT k.doc_id, count(*)::BIGINT AS n_lines, count(f.key)::BIGINT AS n_dropped,
    sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (f.key IS NULL), '')) AS kept_sha256
FROM keyed k LEFT JOIN frequent f ON k.key = f.key
GROUP BY k.row, k.doc_id
"""


@query
def op12_whitened_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings in 64ths, whitened along the 16 leading components."""
    return whitening.whiten(
        table(spark, sf_dir, "embeddings"), components=16,
        component=lambda c: F.when(F.abs(64 * c) < 2.0**51, F.floor(64 * c).cast("double") + 1_000_000),
    )


@query
def op13_importance_draw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth of all documents, drawn by how their words resemble the benchmark's."""
    made = importance.resample(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"),
        runs=1, buckets=10_000, percent=10, min_words=20, seed=2024,
    )
    return made.select("doc_id", "n_features", "weight", "score", "rank")


ORACLES["op13_importance_draw"] = r"""
WITH RECURSIVE bits AS (
    SELECT i, 0 AS step, i AS c FROM range(256) t(i)
    UNION ALL
    SELECT i, step + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END
    FROM bits WHERE step < 8
), remainders AS (
    SELECT list(c ORDER BY i) AS of FROM bits WHERE step = 8
), cut AS (
    SELECT 'here' AS side, row_number() OVER () AS row, doc_id, text FROM documents
    UNION ALL SELECT 'target', row_number() OVER (), NULL, text FROM benchmark
), listed AS (
    SELECT side, row, doc_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
    FROM cut
), counted AS (
    SELECT side, row, word, count(*) AS n FROM (SELECT side, row, unnest(words) AS word FROM listed)
    GROUP BY ALL
), bytes AS (
    SELECT word, list_transform(range(len(code) // 2), lambda i:
        ('0x' || substr(code, 2 * i::INTEGER + 1, 2))::BIGINT) AS held
    FROM (SELECT word, hex(encode(word)) AS code FROM (SELECT DISTINCT word FROM counted))
), hashed AS (
    SELECT word, xor(list_reduce(list_prepend(4294967295::BIGINT, held), lambda c, b:
        xor(c >> 8, of[(xor(c, b) & 255) + 1])), 4294967295) % 10000 AS bucket
    FROM bytes, remainders
), placed AS (
    SELECT side, row, bucket, sum(n) AS n FROM counted JOIN hashed USING (word) GROUP BY ALL
), totals AS (
    SELECT bucket, coalesce(sum(n) FILTER (side = 'here'), 0) AS s,
        coalesce(sum(n) FILTER (side = 'target'), 0) AS t
    FROM placed GROUP BY bucket
), sums AS (
    SELECT sum(s) AS all_s, sum(t) AS all_t FROM totals
), gains AS (
    SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * (all_s + 10000)::DOUBLE
        / ((s + 1)::DOUBLE * (all_t + 10000)::DOUBLE)))::BIGINT AS gain
    FROM totals, sums
), weights AS (
    SELECT row, sum(n * gain)::BIGINT AS weight FROM placed JOIN gains USING (bucket)
    WHERE side = 'here' GROUP BY row
), scored AS (
    SELECT l.row, l.doc_id, len(l.words)::BIGINT AS n_features, coalesce(w.weight, 0) AS weight,
        coalesce(w.weight, 0) + floor(-1000 * ln(-ln((
            ('0x' || substr(sha256('2024:' || coalesce(l.doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE
        ) / 4294967296)))::BIGINT AS score
    FROM listed l LEFT JOIN weights w ON l.row = w.row WHERE l.side = 'here'
), ranked AS (
    SELECT row, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST) AS place, count(*) OVER () AS n
    FROM scored WHERE n_features >= 20
)
SELECT s.doc_id, s.n_features, s.weight, s.score,
    CASE WHEN r.place <= 10 * r.n // 100 THEN r.place END AS rank
FROM scored s LEFT JOIN ranked r ON s.row = r.row
"""
