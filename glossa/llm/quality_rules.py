"""A quality classifier as a sparse ensemble of rules.

Statistics of each text are column expressions. Small trees, grown on boosted residuals
of labelled rows, give candidate rules: each path from the root to a node is a conjunction
of bounds on statistics. A lasso logistic regression keeps few of them and weighs them.
The weighted rules are compiled into one column expression, so scoring is a projection
without Python.

The labelled rows for the fit are a bounded sample, by default 6,000, chosen by a hash of
their id; the statistics come from the whole texts.

Defined cases: a null text is empty; an empty text has statistics 0 and is scored by them;
null labels teach nothing; without labelled rows the score is 0.5, and with one class only
it is the same near 0 or 1 for all; repeated rows get the same score each. Further columns
pass through, but for the one named ``score``, which is replaced.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from glossa.llm.common import word_count

#: The most labelled rows a model is fit on.
SAMPLE_ROWS = 6_000

TREES = 24
DEPTH = 3
CUTS = 24
LEAF_ROWS = 20
SHRINK = 0.3
STEPS = 200
#: Lasso penalties that are tried; the one best on every fifth row is taken.
PENALTIES = (0.01, 0.003, 0.001)

#: Classes of characters, as in a pattern, whose share of the text is a statistic.
SHARES = {
    "upper": "A-Z",
    "lower": "a-z",
    "digit": "0-9",
    "symbol": r"#$%&*@^~<>{}\[\]\\/=+_",
    "shout": "!?",
    "stop": ".,;:",
    "bar": "|",
    "line": r"\n",
}


class Bound(NamedTuple):
    statistic: str
    above: bool
    value: float


class Rule(NamedTuple):
    weight: float
    bounds: tuple[Bound, ...]


class Rules(NamedTuple):
    base: float
    rules: tuple[Rule, ...]


def statistics(text: Column) -> dict[str, Column]:
    """Names and expressions of the statistics of a text that is not null."""
    size = F.greatest(F.length(text), F.lit(1)).cast("double")
    words = F.greatest(word_count(text), F.lit(1)).cast("double")
    found = {
        "log_chars": F.log1p(F.length(text).cast("double")),
        "log_words": F.log1p(word_count(text).cast("double")),
        "word_length": F.length(text) / words,
        "wide": (F.octet_length(text) - F.length(text)) / size,
    }
    for name, letters in SHARES.items():
        found[name] = F.length(F.regexp_replace(text, f"[^{letters}]+", "")) / size
    return found


def with_statistics(docs: DataFrame, text: str) -> DataFrame:
    """``docs`` with a struct ``__stats`` of the statistics."""
    body = docs.withColumn("__body", F.coalesce(F.col(text), F.lit("")))
    made = F.struct(*[c.alias(n) for n, c in statistics(F.col("__body")).items()])
    return body.withColumn("__stats", made).drop("__body")


def _grow(x, gradient, weight, cuts, rows, path, depth, found):
    """Add the paths of a regression tree to ``found`` and give back each row's value."""
    import numpy as np

    value = np.zeros(len(x))
    total, mass = gradient[rows].sum(), weight[rows].sum()
    value[rows] = total / (mass + 1.0)
    if depth == 0 or len(rows) < 2 * LEAF_ROWS:
        return value
    best = (1e-9, None, None)
    for j, edges in enumerate(cuts):
        if not len(edges):
            continue
        place = np.searchsorted(edges, x[rows, j], side="left")
        n = np.cumsum(np.bincount(place, minlength=len(edges) + 1))[:-1]
        g = np.cumsum(np.bincount(place, gradient[rows], len(edges) + 1))[:-1]
        h = np.cumsum(np.bincount(place, weight[rows], len(edges) + 1))[:-1]
        gain = g**2 / (h + 1) + (total - g) ** 2 / (mass - h + 1) - total**2 / (mass + 1)
        gain[(n < LEAF_ROWS) | (len(rows) - n < LEAF_ROWS)] = 0
        k = int(gain.argmax())
        if gain[k] > best[0]:
            best = (gain[k], j, edges[k])
    _, j, edge = best
    if j is None:
        return value
    right = x[rows, j] > edge
    for above in (False, True):
        part = rows[right == above]
        longer = (*path, (j, above, float(edge)))
        found.append(longer)
        made = _grow(x, gradient, weight, cuts, part, longer, depth - 1, found)
        value[part] = made[part]
    return value


def _candidates(x, y):
    """Paths of boosted trees, as tuples of (statistic, above, value)."""
    import numpy as np

    quantiles = np.linspace(0, 1, CUTS + 2)[1:-1]
    cuts = []
    for j in range(x.shape[1]):
        edges = np.unique(np.quantile(x[:, j], quantiles, method="lower"))
        cuts.append(edges[edges < x[:, j].max()])
    found: list[tuple] = []
    score = np.full(len(y), np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    everything = np.arange(len(y))
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-score))
        score += SHRINK * _grow(x, y - p, p * (1 - p), cuts, everything, (), DEPTH, found)
    return list(dict.fromkeys(tuple(sorted(path)) for path in found))


def _holds(x, rule):
    import numpy as np

    out = np.ones(len(x), bool)
    for j, above, value in rule:
        out &= (x[:, j] > value) == above
    return out


def _lasso(z, y, penalty):
    """Weights and base of a logistic regression with an L1 penalty, by accelerated steps."""
    import numpy as np

    n, k = z.shape
    rate = 4 * n / (np.linalg.eigvalsh(z.T @ z)[-1] + n)
    w = v = np.zeros(k)
    b = c = np.log((y.sum() + 1) / (n - y.sum() + 1))
    t = 1.0
    for _ in range(STEPS):
        p = 1 / (1 + np.exp(-(z @ v + c)))
        w0, b0, t0 = w, b, t
        w = v - rate * (z.T @ (p - y)) / n
        w = np.sign(w) * np.maximum(np.abs(w) - rate * penalty, 0)
        b = c - rate * (p - y).mean()
        t = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, c = w + (t0 - 1) / t * (w - w0), b + (t0 - 1) / t * (b - b0)
    return w, b


def fit_rules(names: list[str], rows: list[list[float]], labels: list[int]) -> Rules:
    """Trees, their paths as rules, and the weights that the lasso leaves."""
    import numpy as np

    if not rows:
        return Rules(0.0, ())
    x, y = np.array(rows, float), np.array(labels, float)
    paths = _candidates(x, y) if 0 < y.sum() < len(y) else []
    masks = [_holds(x, path) for path in paths]
    kept = [i for i, m in enumerate(masks) if LEAF_ROWS <= m.sum() <= len(y) - 1]
    if not kept:
        return Rules(float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1))), ())
    z = np.stack([masks[i] for i in kept], 1).astype(float)
    spread = np.maximum(z.std(0), 0.05)
    scaled = (z - z.mean(0)) / spread
    test = np.arange(len(y)) % 5 == 0
    best, chosen = np.inf, PENALTIES[-1]
    for penalty in PENALTIES:
        w, b = _lasso(scaled[~test], y[~test], penalty)
        margin = scaled[test] @ w + b
        loss = np.logaddexp(0, np.where(y[test] > 0, -margin, margin)).mean() if test.any() else 0
        if loss < best - 1e-4:
            best, chosen = loss, penalty
    w, b = _lasso(scaled, y, chosen)
    weights = w / spread
    base = float(b - (weights * z.mean(0)).sum())
    made = [
        Rule(float(weight), tuple(Bound(names[j], above, value) for j, above, value in paths[i]))
        for i, weight in zip(kept, weights)
        if abs(weight) > 1e-6
    ]
    return Rules(base, tuple(made))


def fit(
    docs: DataFrame,
    labels: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    label: str = "label",
    sample_rows: int = SAMPLE_ROWS,
) -> Rules:
    """Fit on rows of ``labels`` (doc_id, label 0 or 1), at most ``sample_rows`` of them."""
    named = labels.select(F.col(doc_id).alias("_doc"), F.col(label).cast("int").alias("_label"))
    named = named.dropna().orderBy(F.xxhash64("_doc"), "_doc", "_label").limit(sample_rows)
    body = docs.select(F.col(doc_id).alias("_key"), F.col(text).alias("_text"))
    both = body.join(F.broadcast(named), F.col("_key") == F.col("_doc"))
    rows = with_statistics(both, "_text").select("_doc", "_label", "__stats.*").collect()
    # A document that is there more than once may bring more rows; the order is fixed.
    rows = sorted(tuple(r) for r in rows)[: 2 * sample_rows]
    names = list(statistics(F.lit("")))
    return fit_rules(names, [list(r[2:]) for r in rows], [r[1] for r in rows])


def compiled(rules: Rules, stats: str = "__stats") -> Column:
    """The score from 0 to 1 as an expression over the struct of statistics."""

    def holds(bound: Bound) -> Column:
        value = F.col(f"{stats}.{bound.statistic}")
        return value > F.lit(bound.value) if bound.above else value <= F.lit(bound.value)

    total = F.lit(rules.base)
    for rule in rules.rules:
        every = reduce(lambda a, b: a & b, [holds(b) for b in rule.bounds])
        total = total + F.when(every, rule.weight).otherwise(0.0)
    return 1 / (1 + F.exp(-total))


def score(docs: DataFrame, rules: Rules, *, text: str = "text") -> DataFrame:
    """``docs`` with ``score``, the probability of label 1."""
    held = with_statistics(docs.drop("score"), text)
    return held.withColumn("score", compiled(rules)).drop("__stats")
