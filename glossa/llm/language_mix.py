"""Languages of documents as a mixture, inferred from n-grams by expectation-maximisation.

Model: counts of hashed byte trigrams of the lower-cased letters of labelled texts, all of
them, summed by Spark; one smoothed distribution for each language, of fixed size.

Inference: a document's trigrams come from its languages in unknown proportions. For all
languages, and then for the likeliest one, two, three, ... of them, expectation-
maximisation finds the proportions; a further language stays only if the log-likelihood
gains more than ``penalty`` times the logarithm of the number of trigrams. The predicted
language is the one with the largest proportion, which is the score.

Defined cases: a text that is null or has no letter is ``und`` with score 0, as is every
text if nothing was learned; a text shorter than a trigram is padded with blanks; rows
whose language or text is null teach nothing; equal proportions go to the language first
in code point order; repeated rows get the same prediction each. Further columns pass
through, but for those named like the ones added.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, DoubleType

#: Trigrams are hashed into so many classes.
BITS = 15
SMOOTH = 0.5
PENALTY = 3.0
ROUNDS = 12
UNKNOWN = "und"

#: Texts, bytes of text, and about so many cells of (trigram, language) worked on at once.
TEXTS = 64
TEXT_BYTES = 2_000_000
CELLS = 4_000_000

#: A model holds 2^15 numbers for each language; more languages than this are refused.
MOST_LANGUAGES = 1_000

ADDED = ("lang_pred", "score", "proportions")


class Model(NamedTuple):
    languages: list[str]
    log: "np.ndarray"  # noqa: F821  languages x classes


def trigrams(texts: list[str]) -> tuple["np.ndarray", "np.ndarray"]:  # noqa: F821
    """(text number, class) of every trigram; runs of non-letters count as blanks."""
    import numpy as np

    blank = bytes(
        b if b >= 128 or chr(b).isalpha() else 32 for b in range(256)
    )
    coded = [t.lower().encode("utf-8", "replace").translate(blank) for t in texts]
    data = np.frombuffer(b"  " + b"  ".join(coded) + b"  ", np.uint8).astype(np.uint32)
    sizes = np.array([len(c) + 2 for c in coded])
    owner = np.repeat(np.arange(len(coded)), sizes)
    a, b, c = data[1:-2], data[2:-1], data[3:]
    use = ~((b == 32) & ((a == 32) | (c == 32)))
    code = ((a << 16) | (b << 8) | c) * np.uint32(2654435761)
    n = min(len(owner), len(code))
    use = use[:n]
    return owner[:n][use], (code[:n][use] >> np.uint32(32 - BITS)).astype(np.int64)


def _slices(batch: pa.RecordBatch, text: str) -> Iterator[pa.RecordBatch]:
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_pylist()
    start = held = 0
    for i, size in enumerate(sizes):
        if i > start and (held + size > TEXT_BYTES or i - start == TEXTS):
            yield batch[start:i]
            start, held = i, 0
        held += size
    if sizes:
        yield batch[start:]


def learn(rows: DataFrame, *, text: str = "text", lang: str = "lang") -> Model:
    """Count the trigrams of all rows by language."""
    import numpy as np

    size = 1 << BITS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            for part in _slices(batch, "text"):
                names = part.column("lang").to_pylist()
                known = {x: i for i, x in enumerate(dict.fromkeys(names))}
                owner, gram = trigrams(part.column("text").to_pylist())
                which = np.array([known[x] for x in names])
                flat = np.bincount(which[owner] * size + gram, minlength=len(known) * size)
                for x, i in known.items():
                    counts = flat[i * size : (i + 1) * size]
                    held[x] = held[x] + counts if x in held else counts
        for x, counts in held.items():
            some = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays(
                [pa.array([x] * len(some)), pa.array(some), pa.array(counts[some])],
                names=["lang", "gram", "n"],
            )

    use = rows.select(F.col(lang).alias("lang"), F.col(text).alias("text")).dropna()
    sums = use.mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram")
    sums = sums.agg(F.sum("n").alias("n"))
    packed = sums.groupBy("lang").agg(F.collect_list(F.struct("gram", "n")).alias("found"))
    counts: dict[str, np.ndarray] = {}
    for r in packed.toLocalIterator():
        if len(counts) == MOST_LANGUAGES:
            raise ValueError(f"more than {MOST_LANGUAGES} languages")
        counts[r["lang"]] = np.zeros(size)
        for gram, n in r["found"]:
            counts[r["lang"]][gram] = n
    names = sorted(counts)
    if not names:
        return Model([], np.zeros((0, size), np.float32))
    table = np.stack([counts[x] for x in names]) + SMOOTH
    return Model(names, np.log(table / table.sum(1, keepdims=True)).astype(np.float32))


def _mixture(p, counts, starts, owner, allowed):
    """Proportions (texts x languages) and log-likelihoods by expectation-maximisation.

    ``p`` has the probability of each trigram in each language, rows of one text side by
    side from ``starts`` on; ``allowed`` masks the languages of each text.
    """
    import numpy as np

    share = allowed / allowed.sum(1, keepdims=True)
    total = np.add.reduceat(counts, starts)[:, None]
    for _ in range(ROUNDS):
        part = p * share[owner]
        mass = part.sum(1)
        share = np.add.reduceat(part * (counts / mass)[:, None], starts, axis=0) / total
        share /= share.sum(1, keepdims=True)
    mass = (p * share[owner]).sum(1)
    return share, np.add.reduceat(counts * np.log(mass), starts)


def infer(texts: list[str | None], model: Model) -> list[tuple[str, float, list[float]]]:
    """Language, score and proportions of each text."""
    import numpy as np

    none = [0.0] * len(model.languages)
    found = [(UNKNOWN, 0.0, none)] * len(texts)
    use = [i for i, t in enumerate(texts) if t and any(c.isalpha() for c in t)]
    if not use or not model.languages:
        return found
    size = 1 << BITS
    owner, gram = trigrams([texts[i] for i in use])
    cells = np.bincount(owner * size + gram, minlength=len(use) * size)
    at = np.flatnonzero(cells)
    counts, owner, gram = cells[at].astype(np.float64), at >> BITS, at & (size - 1)
    has = np.unique(owner)
    owner = np.searchsorted(has, owner)
    use = [use[i] for i in has.tolist()]
    if not use:
        return found
    starts = np.searchsorted(owner, np.arange(len(use)))
    log = model.log[:, gram].T.astype(np.float64)
    single = np.add.reduceat(counts[:, None] * log, starts, axis=0)
    # One factor for each trigram keeps the probabilities in range and cancels out.
    top = log.max(1)
    p = np.exp(log - top[:, None])
    offset = np.add.reduceat(counts * top, starts)

    kinds = len(model.languages)
    share = np.zeros((len(use), kinds))
    first = single.argmax(1)
    share[np.arange(len(use)), first] = 1.0
    best = single.max(1)
    gain = PENALTY * np.log(np.add.reduceat(counts, starts) + 1)
    if kinds > 1:
        full, _ = _mixture(p, counts, starts, owner, np.ones((len(use), kinds)))
        order = np.argsort(-full, axis=1, kind="stable")
        open_ = np.arange(len(use))
        for many in range(2, kinds + 1):
            allowed = np.zeros((len(use), kinds))
            np.put_along_axis(allowed, order[:, :many], 1.0, axis=1)
            pick = np.isin(owner, open_)
            local = np.searchsorted(open_, owner[pick])
            begin = np.searchsorted(local, np.arange(len(open_)))
            made, value = _mixture(p[pick], counts[pick], begin, local, allowed[open_])
            value += offset[open_]
            better = value - best[open_] > gain[open_]
            open_, made, value = open_[better], made[better], value[better]
            if not len(open_):
                break
            share[open_], best[open_] = made, value
    for i, row in zip(use, share):
        k = int(row.argmax())
        found[i] = (model.languages[k], min(1.0, float(row[k])), row.tolist())
    return found


def predict(docs: DataFrame, model: Model, *, text: str = "text") -> DataFrame:
    """``docs`` with lang_pred, score and proportions, in the order of ``model.languages``."""
    names = [c for c in docs.columns if c not in ADDED]
    schema = docs.select(*names).schema.add("lang_pred", "string").add("score", "double")
    schema = schema.add("proportions", ArrayType(DoubleType()))
    most = max(1, CELLS // max(1, len(model.languages)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch, text):
                texts = part.column(text).to_pylist()
                step = max(1, min(len(texts), most >> 10))
                made = [x for i in range(0, len(texts), step) for x in infer(texts[i : i + step], model)]
                langs, scores, shares = zip(*made)
                yield pa.RecordBatch.from_arrays(
                    [
                        *(part.column(n) for n in names), pa.array(langs, pa.string()),
                        pa.array(scores, pa.float64()), pa.array(shares, pa.list_(pa.float64())),
                    ],
                    names=[*names, "lang_pred", "score", "proportions"],
                )

    return docs.select(*names).mapInArrow(run, schema)
