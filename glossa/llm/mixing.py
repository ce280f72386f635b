"""Mixing sources to target weights by capped water-filling.

Targets: every source gets words in proportion to its weight. A source whose share is
over ``max_epochs`` times its size is clamped there, and what it cannot take is shared
among the others by weight, again and again until no source is above its cap.

Sample: of the epochs a source needs, the whole ones repeat all its documents. The
fraction left is a seeded sample of whole documents: they are put in the order of a
digest of seed and id, and taken from the start while at least half of a document still
fits. So each source misses its target by half a document at most, and a rerun takes the
same documents. Rows equal in id and text are one class with a number of rows, so a class
that holds a third of the table is one row in all sums; where the sample ends within a
class, so many of its rows are taken as fit.

Defined cases: null, empty and blank texts have size 0 and are repeated by the whole
epochs only; the null source is a source of its own; for a null id the text is digested;
repeated rows are rows like any other, and which of several equal rows are taken is left
open; no rows give no rows. Further columns pass through, also those named like the ones
added, which are replaced.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from glossa.llm.common import ID_BITS, ranked, word_count, work
from glossa.session import WorkFolder

#: Rows of a source that one task sorts.
SLICE_ROWS = 2_000

ADDED = ("size", "source_size", "target", "repeats", "taken")

_UNIT = 2**32


def cyclic_weights(sizes: DataFrame, weights: Sequence[float], folder: WorkFolder) -> DataFrame:
    """Weights dealt out in turn to the sources by code point, null last."""
    order = ranked(sizes, ["_none", "_source"], folder, "sources")
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    pick = F.element_at(cycle, (F.col("rank") % len(weights) + 1).cast("int"))
    return order.withColumn("weight", pick).drop("rank")


def water_fill(sizes: DataFrame, total: float, max_epochs: float) -> DataFrame:
    """Add ``target`` to a table of (size, weight), one row for each source.

    Each round is one aggregate of the table. Clamped sources stay clamped, as the level
    only rises, so the rounds end; few are needed, since each clamps all that are above.
    """
    cap = F.col("size") * F.lit(float(max_epochs))
    level = 0.0
    clamped = -1
    while True:
        over = cap < F.lit(level) * F.col("weight")
        fixed, free, n = sizes.agg(
            F.coalesce(F.sum(F.when(over, cap)), F.lit(0.0)),
            F.coalesce(F.sum(F.when(over, 0.0).otherwise(F.col("weight"))), F.lit(0.0)),
            F.count_if(over),
        ).first()
        if n == clamped or free <= 0:
            break
        clamped = n
        level = max(0.0, total - fixed) / free
    return sizes.withColumn("target", F.least(cap, F.lit(level) * F.col("weight")))


def digest(doc_id: Column, text: Column, seed: int) -> Column:
    """A long from 0 to 2^32 - 1, the same for the same id and seed."""
    unnamed = F.concat(F.lit("null:"), F.md5(F.coalesce(text, F.lit(""))))
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), unnamed))
    return F.conv(F.substring(F.md5(named), 1, 8), 16, 10).cast("long")


KEY = ("digest", "id", "size", "mark")


def _last_taken(keys: DataFrame, sizes: DataFrame) -> DataFrame:
    """Per source the last class of the fractional sample (``last``) and how many of its
    ``n`` rows are ``taken``; null if the sample is empty.

    Sums of slices, ordered by digest, find the slice in which the sample ends; only the
    classes of that slice are put in order, so a large source is not the work of one task.
    """
    by = ["_source", "_none"]
    wanted = F.col("target") - F.floor("epochs") * F.col("size")
    plan = sizes.select(
        *by, wanted.alias("_want"), F.ceil(F.col("rows") / SLICE_ROWS).alias("_slices")
    )
    dealt = keys.join(plan, by).withColumn(
        "_slice", F.floor(F.col("digest") * F.col("_slices") / F.lit(_UNIT))
    )
    held = F.col("size") * F.col("n")
    last = F.struct(*KEY)
    sums = dealt.groupBy(*by, "_slice", "_want").agg(
        F.sum(held).alias("_sum"), F.max(last).alias("_max"), F.max_by("n", last).alias("n")
    )
    ahead = Window.partitionBy(*by).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("_before", F.coalesce(F.sum("_sum").over(ahead), F.lit(0)))
    whole = F.col("_before") + F.col("_sum") <= F.col("_want")
    edge = ~whole & (F.col("_before") < F.col("_want"))
    full = sums.filter(whole).select(*by, F.col("_max").alias("last"), F.col("n").alias("taken"), "n")
    ends = sums.filter(edge).select(*by, "_slice", "_before")
    inside = Window.partitionBy(*by, "_slice").orderBy(*KEY)
    upto = F.sum(held).over(inside.rowsBetween(Window.unboundedPreceding, 0))
    room = F.col("_want") - (F.col("_before") + F.col("_upto") - held)
    # A row is taken if its middle is within the room.
    fits = F.when(F.col("size") > 0, F.floor(room / F.col("size") + 0.5)).otherwise(F.col("n"))
    part = (
        dealt.join(ends, [*by, "_slice"])
        .withColumn("_upto", upto)
        .withColumn("taken", F.least(fits, F.col("n")).cast("long"))
        .filter("taken > 0")
        .select(*by, last.alias("last"), "taken", "n")
    )
    found = F.max_by(F.struct("last", "taken", "n"), "last").alias("_found")
    return full.unionByName(part).groupBy(*by).agg(found).select(*by, "_found.*")


def mix(
    docs: DataFrame,
    *,
    weights: Sequence[float] = (5, 2, 1),
    share: float = 1.5,
    max_epochs: float = 2.0,
    seed: int = 7,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    size: Column | None = None,
) -> DataFrame:
    """``docs`` with the size and target of each row's source and how often a row is taken.

    ``share`` is the size of the mix as a part of all words. ``size`` replaces the number
    of words as the measure of a row.
    """
    folder = work(docs.sparkSession)
    measure = word_count(F.col(text)) if size is None else size
    # Rows of one id are told apart by their text.
    mark = F.xxhash64(F.coalesce(F.col(text), F.lit("")))
    keys = docs.select(
        F.coalesce(F.col(source).cast("string"), F.lit("")).alias("_source"),
        F.col(source).isNull().alias("_none"),
        F.col(doc_id).alias("id"),
        measure.cast("long").alias("size"),
        digest(F.col(doc_id), F.col(text), seed).alias("digest"),
        mark.alias("mark"),
    )
    keys = folder.write(keys.groupBy(*keys.columns).agg(F.count("*").alias("n")), "keys")
    sizes = keys.groupBy("_source", "_none").agg(
        F.sum(F.col("size") * F.col("n")).alias("size"), F.count("*").alias("rows")
    )
    sizes = folder.write(cyclic_weights(sizes, weights, folder), "weights")
    total = sizes.agg(F.sum("size")).first()[0] or 0
    sizes = folder.write(
        water_fill(sizes, share * total, max_epochs).withColumn(
            "epochs", F.when(F.col("size") > 0, F.col("target") / F.col("size")).otherwise(0.0)
        ),
        "targets",
    )
    plan = sizes.join(_last_taken(keys, sizes), ["_source", "_none"], "left").select(
        F.col("_source").alias("__mix_s"), F.col("_none").alias("__mix_n"),
        F.col("size").alias("__mix_source_size"), F.col("target").alias("__mix_target"),
        F.floor("epochs").alias("__mix_whole"), F.col("last").alias("__mix_last"),
        F.col("taken").alias("__mix_taken"), F.col("n").alias("__mix_n_last"),
    )
    plan = folder.write(plan, "plan")
    rest = docs.drop(*ADDED)
    sized = rest.withColumn("__mix_size", measure.cast("long"))
    key = F.struct(
        digest(F.col(doc_id), F.col(text), seed).alias("digest"), F.col(doc_id).alias("id"),
        F.col("__mix_size").alias("size"), mark.alias("mark"),
    )
    at = (F.coalesce(F.col(source).cast("string"), F.lit("")) == F.col("__mix_s")) & (
        F.col(source).isNull() == F.col("__mix_n")
    )
    placed = sized.join(plan, at)
    cut = F.col("__mix_taken") < F.col("__mix_n_last")
    more = F.when((F.col("__mix_size") > 0) & (key <= F.col("__mix_last")), 1).otherwise(0)
    whole = placed.withColumn("__mix_more", more)
    if not plan.filter(cut).isEmpty():
        tied = F.coalesce(cut & (key == F.col("__mix_last")), F.lit(False))
        some = F.when(F.col("__mix_no") < F.col("__mix_taken"), 1).otherwise(0)
        ties = _numbered(placed.filter(tied), folder).withColumn("__mix_more", some)
        whole = whole.filter(~tied).unionByName(ties.drop("__mix_no"))
    return whole.withColumn(
        "repeats", (F.col("__mix_whole") + F.col("__mix_more")).cast("long")
    ).select(
        *[F.col(c) for c in rest.columns],
        F.col("__mix_size").alias("size"), F.col("__mix_source_size").alias("source_size"),
        F.col("__mix_target").alias("target"), "repeats",
        (F.col("repeats") * F.col("__mix_size")).alias("taken"),
    )


def _numbered(rows: DataFrame, folder: WorkFolder) -> DataFrame:
    """``rows`` with ``__mix_no``, from 0 within each source, by the counts of partitions."""
    by = ["__mix_s", "__mix_n", "__mix_part"]
    kept = folder.write(rows.withColumn("__mix_id", F.monotonically_increasing_id()), "ties")
    kept = kept.withColumn("__mix_part", F.shiftrightunsigned("__mix_id", ID_BITS))
    ahead = Window.partitionBy(*by[:2]).orderBy("__mix_part")
    before = F.sum("__mix_count").over(ahead.rowsBetween(Window.unboundedPreceding, -1))
    starts = kept.groupBy(*by).agg(F.count("*").alias("__mix_count"))
    starts = starts.select(*by, F.coalesce(before, F.lit(0)).alias("__mix_start"))
    inside = F.row_number().over(Window.partitionBy(*by).orderBy("__mix_id")) - 1
    made = kept.withColumn("__mix_no", inside).join(starts, by)
    number = F.col("__mix_start") + F.col("__mix_no")
    return made.withColumn("__mix_no", number).drop("__mix_part", "__mix_id", "__mix_start")


def repeated(mixed: DataFrame) -> DataFrame:
    """The rows of the mix, each as often as it is taken, without the added columns."""
    columns = [c for c in mixed.columns if c not in ADDED]
    times = F.sequence(F.lit(1), F.col("repeats"))
    return mixed.filter("repeats > 0").withColumn("__mix_copy", F.explode(times)).select(*columns)
