"""Secrets in texts: fixed patterns, and a battery of tests for random strings.

Everything is a column expression; the only thing the driver sees is a histogram of fixed
size.

Patterns: assignments to names like ``password``, access keys, and long hex numbers.

Battery: every run of 20 or more characters of the base64 alphabets that holds a letter
and a digit is a candidate. Its encoding is the smallest alphabet that has all its
characters. Under the hypothesis that these are drawn independently and uniformly, three
tests give p-values: chi-squared of the counts (Wilson-Hilferty), runs above and below
the middle of the alphabet (Wald-Wolfowitz), and serial correlation at lag one. Fisher's
method combines them to one.

False discoveries: what must not be reported are names, paths and numbers. Their model is
a chain of pairs of characters: how kinds of characters (capital, small, digit, sign)
follow each other in names, and how frequent each letter is. The evidence of a candidate
is the ratio of its chance in its encoding to its chance in that chain, times the battery's
p-value, which is below one. Under the chain its mean is at most one whatever the encoding
and the length, so its inverse bounds a p-value (Markov). The candidates with the smallest
are accepted by the Benjamini-Hochberg rule, for each class of lengths apart, as short
strings cannot reach the p-values that long ones do, and one rule for all would let the
long ones pay for the short. The p-values are counted in bins. A candidate is left out
only where a pattern's span holds all of it; spans may overlap.

Defined cases: a null text is empty; texts without candidates have no spans; a table
without candidates accepts none; repeated rows each get the same spans; further columns
pass through, but for one named like the added one.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

#: The patterns, and the least length of what must be long.
ASSIGN = (
    r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?"""
    r"([A-Za-z0-9+/_.=-]+)"
)
ASSIGN_VALUE = 12
ACCESS = r"AKIA[A-Z0-9]+"
ACCESS_LENGTH = 18
HEX = r"[0-9a-f]{16,}"
KINDS = ("assign", "access", "hex", "random")

CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
#: Alphabets from small to large; the first that has all characters is taken.
ALPHABETS = {
    "hex": "0123456789abcdef",
    "HEX": "0123456789ABCDEF",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "lower": "0123456789abcdefghijklmnopqrstuvwxyz",
    "upper": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "base62": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
    "base64url": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_",
}
#: The share of false discoveries allowed.
FALSE_SHARE = 0.01
#: Of names, how often a kind of character begins one, and follows each kind;
#: kinds are capital, small, digit, sign.
FIRST = (0.3, 0.5, 0.15, 0.05)
FOLLOWS = (
    (0.45, 0.45, 0.05, 0.05),
    (0.05, 0.88, 0.03, 0.04),
    (0.04, 0.06, 0.82, 0.08),
    (0.20, 0.50, 0.25, 0.05),
)
#: Percentages of the letters A to Z in written English.
LETTERS = (
    8.2, 1.5, 2.8, 4.3, 12.7, 2.2, 2.0, 6.1, 7.0, 0.2, 0.8, 4.0, 2.4,
    6.7, 7.5, 1.9, 0.1, 6.0, 6.3, 9.1, 2.8, 1.0, 2.4, 0.2, 2.0, 0.1,
)
#: Other languages have other letters: this share of all is even.
EVEN = 0.2
#: Lower ends of the classes of lengths.
LENGTHS = (20, 28, 40, 64)
#: Bins of the evidence for each unit, and the most that is told apart.
BINS_PER_UNIT = 20
TOP_SCORE = 40

SPAN = "array<struct<start: int, kind: int, end: int>>"
_CHUNK = 256


def _once(value: Column, fn: Callable[[Column], Column]) -> Column:
    """``fn`` of a value that is computed, and stands in the plan, once."""
    return F.element_at(F.transform(F.array(value), fn), 1)


def _phi(z: Column) -> Column:
    """The normal distribution, by a logistic curve that is within 0.0002 of it."""
    return _once(z, lambda z: 1 / (1 + F.exp(-1.5976 * z - 0.07056 * z * z * z)))


def places(text: Column, pattern: str, hits: Column) -> Column:
    """Start and end, in characters, of the matches ``hits`` of a pattern, in order.

    The text between the matches gives the gaps. Sums run over chunks, as a list that
    grows by one element at a time would take quadratic time in texts with many matches.
    """
    gaps = F.split(text, pattern, -1)
    both = F.zip_with(
        F.slice(gaps, 1, F.size(hits)), hits,
        lambda g, h: F.struct(F.length(g).alias("gap"), F.length(h).alias("size")),
    )

    def state(at: Column, done: Column) -> Column:
        return F.struct(at.alias("at"), done.alias("done"))

    def step(s: Column, x: Column) -> Column:
        start = s["at"] + x["gap"]
        end = start + x["size"]
        return state(end, F.concat(s["done"], F.array(F.struct(start.alias("start"), end.alias("end")))))

    none = F.array().cast("array<struct<start: int, end: int>>")

    def chunk(s: Column, i: Column) -> Column:
        inner = F.aggregate(F.slice(both, i * _CHUNK + 1, _CHUNK), state(s["at"], none), step)
        return state(inner["at"], F.concat(s["done"], inner["done"]))

    chunks = F.sequence(F.lit(0), F.floor((F.size(hits) - 1) / _CHUNK).cast("int"))
    made = F.aggregate(chunks, state(F.lit(0), none), chunk, lambda s: s["done"])
    return F.when(F.size(hits) > 0, made).otherwise(none)


def _spans(found: Column, keep: Column, kind: str) -> Column:
    """Spans of the kept matches; ``keep`` has a flag for each."""
    number = F.lit(KINDS.index(kind))
    each = F.zip_with(
        found, keep,
        lambda p, k: F.when(
            k, F.struct(p["start"].alias("start"), number.alias("kind"), p["end"].alias("end"))
        ),
    )
    return F.filter(each, lambda s: s.isNotNull())


def _everything() -> str:
    """All characters of the alphabets: capitals, small letters, digits, signs."""
    return "".join(dict.fromkeys(ALPHABETS["base64"] + ALPHABETS["base64url"] + "="))


def _as_name(letters: Column) -> Column:
    """The logarithm of the chance of characters, given in a list, in the chain of names."""
    every = _everything()
    signs = math.log(1 / sum(not c.isalnum() for c in every))
    shares = [math.log((1 - EVEN) * x / 100 + EVEN / 26) for x in LETTERS]
    of_letter = F.array(*map(F.lit, shares))
    pairs = F.array(*[F.lit(math.log(p)) for row in (*FOLLOWS, FIRST) for p in row])

    def step(s: Column, c: Column) -> Column:
        """``s``: kind of the character before (4 for none) and the sum so far."""
        place = F.instr(F.lit(every), c)
        kind = F.when(place > 62, 3).when(place > 52, 2).when(place > 26, 1).otherwise(0)
        share = F.when(place > 62, signs).when(place > 52, math.log(1 / 10)).otherwise(
            F.element_at(of_letter, F.pmod(place - 1, F.lit(26)) + 1)
        )
        after = F.element_at(pairs, 4 * s["kind"] + kind + 1)
        return F.struct(kind.alias("kind"), (s["sum"] + after + share).alias("sum"))

    start = F.struct(F.lit(4).alias("kind"), F.lit(0.0).alias("sum"))
    return F.aggregate(letters, start, step, lambda s: s["sum"])


def battery(token: Column) -> Column:
    """A struct for a candidate: size and score, the evidence that it is random and no name."""
    bare = F.rtrim(token, F.lit("="))
    alphabet = F.lit(None).cast("string")
    for letters in reversed(ALPHABETS.values()):
        fits = F.length(F.translate(bare, letters, "")) == 0
        alphabet = F.when(fits, F.lit(letters)).otherwise(alphabet)
    alphabet = F.coalesce(alphabet, F.lit(_everything()))

    def tests(x: Column) -> Column:
        """``x``: (digits, n, k), the places of the characters in an alphabet of k."""
        n, k, at = x["n"].cast("double"), x["k"].cast("double"), x["at"]
        counts = F.transform(
            F.array_distinct(at), lambda v: F.size(F.filter(at, lambda w: w == v)).cast("double")
        )
        squares = F.aggregate(counts, F.lit(0.0), lambda s, c: s + c * c)
        df = k - 1
        ratio = (k / n * squares - n) / df
        chi = (F.pow(F.greatest(ratio, F.lit(0.0)), F.lit(1 / 3)) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df))
        p_chi = 1 - _phi(chi)

        pairs = F.zip_with(
            F.slice(at, 1, x["n"] - 1), F.slice(at, 2, x["n"] - 1),
            lambda a, b: F.struct(a.alias("a"), b.alias("b")),
        )
        high = F.size(F.filter(at, lambda v: v >= k / 2)).cast("double")
        low = n - high
        turns = F.size(F.filter(pairs, lambda q: (q["a"] >= k / 2) != (q["b"] >= k / 2)))
        mean = 2 * high * low / n + 1
        spread = F.sqrt(F.greatest((mean - 1) * (mean - 2) / (n - 1), F.lit(1e-9)))
        p_runs = 2 * (1 - _phi(F.abs((turns + 1 - mean) / spread)))

        middle = F.aggregate(at, F.lit(0.0), lambda s, v: s + v) / n
        var = F.aggregate(at, F.lit(0.0), lambda s, v: s + (v - middle) * (v - middle))
        lag = F.aggregate(
            pairs, F.lit(0.0), lambda s, q: s + (q["a"] - middle) * (q["b"] - middle)
        )
        r = F.when(var > 0, lag / var).otherwise(1.0)
        p_serial = 2 * (1 - _phi(F.abs((r + 1 / n) * F.sqrt(n))))

        def log(p: Column) -> Column:
            return F.log(F.greatest(p, F.lit(1e-15)))

        fisher = _once(
            -(log(p_chi) + log(p_runs) + log(p_serial)),
            lambda t: F.log(F.greatest(1 + t + t * t / 2, F.lit(1.0))) - t,
        )
        score = fisher - n * F.log(k) - x["name"]
        return F.struct(x["n"].alias("size"), score.alias("score"))

    letters = F.split(bare, "")
    parts = F.struct(
        F.transform(letters, lambda c: F.instr(alphabet, c) - 1).alias("at"),
        F.length(bare).alias("n"), F.length(alphabet).alias("k"), _as_name(letters).alias("name"),
    )
    return F.element_at(F.transform(F.array(parts), tests), 1)


def _length_class(size: Column) -> Column:
    number = F.lit(0)
    for i, low in enumerate(LENGTHS):
        number = F.when(size >= low, i).otherwise(number)
    return number


def scanned(docs: DataFrame, text: str) -> DataFrame:
    """``docs`` with ``__scan_base``, the spans of the patterns, and ``__scan_tokens``, the candidates."""
    body = F.coalesce(F.col(text), F.lit(""))
    found = docs.withColumns(
        {
            "__scan_a": F.regexp_extract_all(body, F.lit(ASSIGN), F.lit(0)),
            "__scan_k": F.regexp_extract_all(body, F.lit(ACCESS), F.lit(0)),
            "__scan_h": F.regexp_extract_all(body, F.lit(HEX), F.lit(0)),
            "__scan_c": F.regexp_extract_all(body, F.lit(CANDIDATE), F.lit(0)),
        }
    )
    value = F.regexp_extract_all(body, F.lit(ASSIGN), F.lit(2))
    base = F.concat(
        _spans(
            places(body, ASSIGN, F.col("__scan_a")),
            F.when(
                F.size("__scan_a") > 0, F.transform(value, lambda v: F.length(v) >= ASSIGN_VALUE)
            ).otherwise(F.array().cast("array<boolean>")),
            "assign",
        ),
        _spans(
            places(body, ACCESS, F.col("__scan_k")),
            F.transform("__scan_k", lambda v: F.length(v) >= ACCESS_LENGTH), "access",
        ),
        _spans(places(body, HEX, F.col("__scan_h")), F.transform("__scan_h", lambda v: F.lit(True)), "hex"),
    )
    mixed = F.transform("__scan_c", lambda v: v.rlike("[0-9]") & v.rlike("[A-Za-z]"))
    tokens = F.zip_with(
        _spans(places(body, CANDIDATE, F.col("__scan_c")), F.transform("__scan_c", lambda v: F.lit(True)), "random"),
        F.zip_with("__scan_c", mixed, lambda v, m: F.when(m, battery(v))),
        lambda s, b: F.struct(s.alias("span"), b.alias("test")),
    )
    found = found.withColumns({"__scan_base": F.array_sort(base), "__scan_tokens": tokens})
    return found.withColumn(
        "__scan_tokens",
        F.filter(
            "__scan_tokens",
            lambda t: t["test"].isNotNull()
            & ~F.exists(
                "__scan_base",
                lambda b: (b["start"] <= t["span"]["start"]) & (t["span"]["end"] <= b["end"]),
            ),
        ),
    ).drop("__scan_a", "__scan_k", "__scan_h", "__scan_c")


def thresholds(docs: DataFrame, text: str) -> list[float | None]:
    """For each class of lengths the least evidence that is accepted, None to accept none."""
    each = scanned(docs.select(F.col(text).alias("text")), "text")
    tests = each.select(F.explode("__scan_tokens.test").alias("t"))
    last = BINS_PER_UNIT * TOP_SCORE
    score = F.floor(F.col("t.score") * BINS_PER_UNIT)
    score = F.least(F.greatest(score, F.lit(0)), F.lit(last))
    counts = tests.groupBy(
        _length_class(F.col("t.size")).alias("class"), F.coalesce(score, F.lit(0)).alias("bin")
    ).count()
    held: dict[int, dict[int, int]] = {i: {} for i in range(len(LENGTHS))}
    for r in counts.collect():
        held[r["class"]][r["bin"]] = r["count"]
    found: list[float | None] = []
    for bins in held.values():
        total, above, least = sum(bins.values()), 0, None
        for b in range(last, 0, -1):
            above += bins.get(b, 0)
            p = math.exp(-b / BINS_PER_UNIT)
            if above and p <= FALSE_SHARE * above / total:
                least = b / BINS_PER_UNIT
        found.append(least)
    return found


def scan(docs: DataFrame, *, text: str = "text") -> DataFrame:
    """``docs`` with ``secrets``: start, kind (a number, see ``KINDS``) and end of each span."""
    least = thresholds(docs, text)
    held = scanned(docs.drop("secrets"), text)
    bound = F.array(*[F.lit(math.inf if x is None else x) for x in least])

    def accepted(t: Column) -> Column:
        enough = F.element_at(bound, _length_class(t["test"]["size"]) + 1)
        return t["test"]["score"] >= enough

    more = F.transform(F.filter("__scan_tokens", accepted), lambda t: t["span"])
    spans = F.array_sort(F.concat("__scan_base", more))
    return held.withColumn("secrets", spans).drop("__scan_base", "__scan_tokens")


def listed(spans: Column) -> Column:
    """``kind:start:end`` of spans, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    one: Callable[[Column], Column] = lambda s: F.concat_ws(
        ":", F.element_at(names, s["kind"] + 1), s["start"], s["end"]
    )
    return F.array_join(F.transform(spans, one), ",")


def redacted(text: Column, spans: Column, mark: str = "[secret]") -> Column:
    """The text with the union of the spans replaced by a mark; null stays null."""

    def step(s: Column, x: Column) -> Column:
        gap = F.substring(text, s["at"] + 1, x["start"] - s["at"])
        fresh = x["start"] >= s["at"]
        add = F.when(fresh, F.concat(s["done"], F.array(gap, F.lit(mark)))).otherwise(s["done"])
        return F.struct(F.greatest(s["at"], x["end"]).alias("at"), add.alias("done"))

    first = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("done"))
    made = F.aggregate(
        spans, first, step,
        lambda s: F.concat(
            F.array_join(s["done"], ""), F.substring(text, s["at"] + 1, F.length(text))
        ),
    )
    return F.when(F.size(spans) > 0, made).otherwise(text)
