"""Text functions on columns; all run in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

from glossa.settings import (
    BOUNDARIES,
    SPACE,
    SPACE_CHARS,
    TRANSLATE_KEYS,
    char_budget,
    token_limit,
)

Text = Column | str


def _col(c: Text) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it many times in ``body``."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


# --------------------------------------------------------------------- cells


def cell_text(c: Text) -> Column:
    """The cell as text; null becomes the empty string."""
    return F.coalesce(_col(c).cast("string"), F.lit(""))


def double_text(c: Text) -> Column:
    """A double in the form Python writes it; Java goes over to exponents elsewhere."""
    x = _col(c)
    java = x.cast("string")
    plain = F.rtrim(x.cast("decimal(38,21)").cast("string"), F.lit("0"))
    exponent = F.regexp_extract(java, r"E(-?\d+)$", 1)
    sign = F.when(exponent.startswith("-"), "-").otherwise("+")
    digits = F.ltrim(exponent, F.lit("-"))
    size = F.abs(x)
    return (
        F.when(F.isnan(x), F.lit(None).cast("string"))
        .when(size == float("inf"), F.when(x > 0, "inf").otherwise("-inf"))
        .when(
            ((size >= 1e7) & (size < 1e16)) | ((size >= 1e-4) & (size < 1e-3)),
            F.when(plain.endswith("."), F.concat(plain, F.lit("0"))).otherwise(plain),
        )
        .when(
            java.contains("E"),
            F.concat(
                F.regexp_replace(F.regexp_extract(java, "^(.*)E", 1), r"\.0$", ""),
                F.lit("e"),
                sign,
                F.when(F.length(digits) < 2, F.lpad(digits, 2, "0")).otherwise(digits),
            ),
        )
        .otherwise(java)
    )


def strip(c: Text) -> Column:
    return F.btrim(_col(c), F.lit(SPACE_CHARS))


def is_translatable(c: Text) -> Column:
    """True for text that holds anything but whitespace."""
    return F.coalesce(F.ltrim(_col(c), F.lit(SPACE_CHARS)) != "", F.lit(False))


def looks_json(c: Text) -> Column:
    """A cheap test every JSON object or array passes: its first sign is [ or {."""
    first = F.substring(F.ltrim(_col(c), F.lit(SPACE_CHARS)), 1, 1)
    return F.coalesce(first.isin("[", "{"), F.lit(False))


# -------------------------------------------------------------------- tokens


def estimate_tokens(c: Text) -> Column:
    """One token per four characters, at least one for any text."""
    n = F.coalesce(F.length(_col(c)), F.lit(0))
    return F.when(n == 0, F.lit(0)).otherwise(F.greatest(F.lit(1), F.shiftright(n, 2)))


def fits_limit(c: Text, max_tokens: int) -> Column:
    return estimate_tokens(c) <= F.lit(token_limit(max_tokens))


# ------------------------------------------------------------------ chunking


def split_boundaries(c: Text) -> Column:
    """Cut text at the coarsest boundary that gives several parts, else in half."""
    text = _col(c)

    def several(pattern: str) -> Column:
        parts = F.filter(F.split(text, pattern), lambda p: F.ltrim(p, F.lit(SPACE_CHARS)) != "")
        return F.get(F.filter(F.array(parts), lambda ps: F.size(ps) > 1), F.lit(0))

    def halves(words: Column) -> Column:
        middle = F.shiftright(F.size(words), 1)
        return F.when(
            F.size(words) > 1,
            F.array(
                F.array_join(F.slice(words, F.lit(1), middle), " "),
                F.array_join(F.slice(words, middle + 1, F.size(words)), " "),
            ),
        )

    words = F.filter(F.split(text, f"{SPACE}+"), lambda w: w != "")
    return F.coalesce(*(several(p) for p in BOUNDARIES), let(words, halves), F.array(text))


def pack_chunks(parts: Column, max_tokens: int) -> Column:
    """Join neighbouring parts with a space, as many as the limit allows.

    Only lengths are carried along while packing; the chunks are put together
    once at the end, so the work is linear in the text.
    """
    budget = F.lit(char_budget(max_tokens))
    spaces = F.lit(SPACE_CHARS)

    def step(acc: Column, p: Column) -> Column:
        # Few parts end in whitespace, and a look at the last sign is cheap.
        ragged = F.instr(spaces, F.right(p, F.lit(1))) > 0
        more = F.when(ragged, F.length(F.rtrim(p, spaces))).otherwise(F.length(p)) + 1
        joined = acc["size"] + more
        fits = (acc["at"] > 0) & (joined <= budget)
        # An over-long part never takes a neighbour in, so its full length counts.
        held = F.when(F.length(p) > budget, F.length(p)).otherwise(F.length(F.ltrim(p, spaces)))
        return F.struct(
            F.when(fits, acc["starts"])
            .otherwise(F.array_append(acc["starts"], acc["at"]))
            .alias("starts"),
            F.when(fits, joined).otherwise(held).alias("size"),
            (acc["at"] + 1).alias("at"),
            (acc["ragged"] | ragged).alias("ragged"),
        )

    def chunk(ps: Column, start: Column, count: Column, ragged: Column) -> Column:
        mine = F.slice(ps, start + 1, count)
        tidy = F.transform(mine, lambda p, k: F.when(k == 0, p).otherwise(F.rtrim(p, spaces)))
        joined = F.array_join(F.when(ragged, tidy).otherwise(mine), " ")
        return F.when(count == 1, F.get(ps, start)).otherwise(F.ltrim(joined, spaces))

    def cut(ps: Column) -> Column:
        empty = F.struct(
            F.array().cast("array<int>").alias("starts"),
            F.lit(0).alias("size"),
            F.lit(0).alias("at"),
            F.lit(False).alias("ragged"),
        )
        return let(
            F.aggregate(ps, empty, step),
            lambda acc: F.transform(
                acc["starts"],
                lambda s, k: chunk(
                    ps, s, F.coalesce(F.get(acc["starts"], k + 1), F.size(ps)) - s, acc["ragged"]
                ),
            ),
        )

    return let(parts, cut)


# ------------------------------------------------------- prompts, keys, names


def prompt_parts(
    source_lang: str, target_lang: str, system_prompt: str, template: str
) -> list[tuple[str, list[str]]]:
    """(role, pieces) of each message; the text goes between the pieces.

    The languages go in before the text does, so braces in the text are safe.
    """
    asked = template.replace("{src}", source_lang).replace("{tgt}", target_lang)
    parts = [("user", asked.split("{text}"))]
    if system_prompt:
        told = system_prompt.replace("{source}", source_lang).replace("{target}", target_lang)
        parts.insert(0, ("system", [told]))
    return parts


def render_prompt(
    c: Text, source_lang: str, target_lang: str, system_prompt: str, template: str
) -> Column:
    """The chat messages for one text, as an array of (role, content)."""

    def content(pieces: list[str]) -> Column:
        if len(pieces) == 1:
            return F.lit(pieces[0])
        between = [x for piece in pieces[1:] for x in (_col(c), F.lit(piece))]
        return F.concat(F.lit(pieces[0]), *between)

    parts = prompt_parts(source_lang, target_lang, system_prompt, template)
    return F.array(
        *(F.struct(F.lit(role).alias("role"), content(p).alias("content")) for role, p in parts)
    )


def parse_key_list(c: Text, default: tuple[str, ...] = TRANSLATE_KEYS) -> Column:
    """Keys from a comma list; a list without keys means the default."""
    keys = F.filter(F.transform(F.split(_col(c), ","), strip), lambda k: k != "")
    fallback = F.array(*(F.lit(k) for k in default))
    return let(keys, lambda ks: F.when(F.size(ks) > 0, ks).otherwise(fallback))


def job_key(dataset: Text, split: Text) -> Column:
    return F.substring(F.sha2(F.concat_ws("::", _col(dataset), _col(split)), 256), 1, 12)


def safe_name(c: Text) -> Column:
    return F.translate(_col(c), "/\\", "__")


def safe_name_of(name: str) -> str:
    return name.replace("/", "_").replace("\\", "_")
