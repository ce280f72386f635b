"""Chunking of texts with a part that is itself over the limit.

Such a part is cut again, as often as it takes. That depth depends on the data,
so these rows (about one in a thousand at the default limit) go through Python.
"""

from __future__ import annotations

import re
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, functions as F

from glossa.functions.text import is_translatable, let, pack_chunks, split_boundaries
from glossa.settings import BOUNDARIES, char_budget


_BOUNDARIES = [re.compile(b) for b in BOUNDARIES]
_INK = re.compile(r"\S")

#: A part of a text, by the places of its first sign and of the one behind its last.
Span = tuple[int, int]


def _spans(text: str, start: int, end: int) -> list[Span]:
    """The parts between the coarsest boundaries that leave several; none if none does."""
    for boundary in _BOUNDARIES:
        edges = [start]
        for gap in boundary.finditer(text, start, end):
            edges += gap.span()
        edges.append(end)
        found = [s for s in zip(edges[::2], edges[1::2]) if _INK.search(text, *s)]
        if len(found) > 1:
            return found
    return []


def _runs(text: str, spans: list[Span], budget: int) -> list[list[Span]]:
    """Neighbours that fit together, with one blank between them."""
    runs: list[list[Span]] = []
    room = -1
    for start, end in spans:
        tail = end - start - len(text[start:end].rstrip())
        if runs and end - start - tail + 1 <= room:
            room -= end - start - tail + 1
            runs[-1].append((start, end - tail))
        else:
            ink = _INK.search(text, start, end)
            runs.append([(start, end)])
            room = budget - (end - (ink.start() if ink and end - start <= budget else start))
    return runs


def _halves(words: list[str], budget: int) -> list[str]:
    """Words in halves of halves, until they fit or are single."""
    ends = [0, *accumulate(len(w) + 1 for w in words)]
    done: list[str] = []
    todo = [(0, len(words))]
    while todo:
        low, high = todo.pop()
        if ends[high] - ends[low] - 1 <= budget or high - low == 1:
            done.append(" ".join(words[low:high]))
        else:
            middle = low + (high - low) // 2
            todo += [(middle, high), (low, middle)]
    return done


def deep_chunks(text: str, budget: int) -> list[str]:
    """Chunks of a text; parts over the budget are cut at finer boundaries again.

    Parts are places in the text until they are chunks, so none is copied on the way.
    """
    if not text.strip():
        return [text]
    done: list[str] = []
    todo: list[list[Span]] = [[(0, len(text))]]
    while todo:
        run = todo.pop()
        (start, end), *others = run
        if others:
            done.append(" ".join(text[a:b] for a, b in run).lstrip())
        elif end - start <= budget:
            done.append(text[start:end])
        elif spans := _spans(text, start, end):
            todo += reversed(_runs(text, spans, budget))
        else:
            words = text[start:end].split()
            done += _halves(words, budget) if len(words) > 1 else [text[start:end]]
    return done


def deep_chunks_udf(budget: int):
    @F.arrow_udf("array<string>")
    def run(texts: pa.Array) -> pa.Array:
        found = [None if t is None else deep_chunks(t, budget) for t in texts.to_pylist()]
        return pa.array(found, type=pa.list_(pa.string()))

    return run


def shallow_chunks(text: Column, max_tokens: int) -> Column:
    """Chunks in the JVM; null where a part is over the limit on its own."""
    budget = F.lit(char_budget(max_tokens))

    def packed(parts: Column) -> Column:
        return F.when(
            ~F.exists(parts, lambda p: F.length(p) > budget), pack_chunks(parts, max_tokens)
        )

    whole = (F.length(text) <= budget) | ~is_translatable(text)
    return F.when(whole, F.array(text)).otherwise(let(split_boundaries(text), packed))
