"""JSON held in text cells.

Spark's own JSON readers accept text after the document and reorder keys, so the
documents are parsed in Arrow batches with Python's json. Only cells whose first
sign is [ or { are sent there.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, functions as F

from glossa.functions.text import Text, _col, looks_json
from glossa.settings import SKIP_KEYS, TRANSLATE_KEYS

LEAF_TYPE = pa.list_(
    pa.struct([("leaf_ord", pa.int32()), ("path", pa.string()), ("text", pa.string())])
)
KEYS_TYPE = pa.list_(pa.string())

_SCALAR = r'^[ \t\n\r]*(?:[\[{"]|-?[0-9]|(?:true|false|null|NaN|-?Infinity)[ \t\n\r]*$)'
_SURROGATE = re.compile("[\ud800-\udfff]")


# ---------------------------------------------------------------- one document


def container(text: str | None) -> dict | list | None:
    """The parsed document if it is an object or an array, else None."""
    try:
        parsed = json.loads(text.strip()) if text else None
    except (ValueError, RecursionError):
        return None
    return parsed if isinstance(parsed, (dict, list)) else None


def slots(
    document: dict | list, translate: frozenset, skip: frozenset
) -> Iterator[tuple[dict, str, tuple]]:
    """Places of translatable strings, in document order: (object, key, path).

    ``path`` is a linked tuple (parent path, step); ``show_path`` prints it.
    """
    todo: list[tuple] = [(document, ())]
    while todo:
        node, path = todo.pop()
        if isinstance(node, tuple):
            yield (*node, path)
            continue
        below: list[tuple] = []
        if isinstance(node, list):
            steps = enumerate(node)
        else:
            steps = ((k, v) for k, v in node.items() if k not in skip)
        for step, value in steps:
            if isinstance(value, (dict, list)):
                below.append((value, (path, step)))
            elif (
                isinstance(node, dict)
                and step in translate
                and isinstance(value, str)
                and value.strip()
            ):
                below.append(((node, step), (path, step)))
        todo.extend(reversed(below))


def show_path(path: tuple) -> str:
    steps: list[str] = []
    while path:
        path, step = path
        if isinstance(step, int):
            steps.append(f"[{step}]")
        else:
            steps.append(f".{step}" if re.fullmatch(r"[A-Za-z0-9_]+", step) else f'."{step}"')
    return "$" + "".join(reversed(steps))


def utf8(text: str) -> str:
    """Half a surrogate pair cannot be stored as UTF-8; show it as unknown."""
    return _SURROGATE.sub("\ufffd", text)


def dump(document: dict | list) -> str:
    shown = json.dumps(document, ensure_ascii=False, indent=2)
    return _SURROGATE.sub(lambda m: f"\\u{ord(m[0]):04x}", shown)


def top_keys(document: dict | list) -> list[str]:
    """Keys of the object, or of the objects that are items of the array."""
    objects = document if isinstance(document, list) else [document]
    return sorted({utf8(k) for o in objects if isinstance(o, dict) for k in o})


def leaves_of(text: str, translate: frozenset, skip: frozenset) -> list[dict] | None:
    document = container(text)
    if document is None:
        return None
    return [
        {"leaf_ord": n, "path": utf8(show_path(path)), "text": utf8(holder[key])}
        for n, (holder, key, path) in enumerate(slots(document, translate, skip))
    ]


def rebuilt(
    text: str, pieces: list[dict] | None, translate: frozenset, skip: frozenset
) -> str | None:
    """The document with its leaves replaced; a leaf with a failed piece stays."""
    document = container(text)
    if document is None:
        return None
    found: dict[int, list] = {}
    for piece in pieces or ():
        found.setdefault(piece["leaf_ord"], []).append(piece["tgt"])
    places = list(slots(document, translate, skip))
    for n, (holder, key, _) in enumerate(places):
        parts = found.get(n)
        if parts and None not in parts:
            holder[key] = " ".join(parts)
    try:
        return dump(document)
    except (TypeError, ValueError, RecursionError):
        return text


# -------------------------------------------------------------------- columns


def _on_json(c: Text) -> Column:
    return F.when(looks_json(c), _col(c))


def is_json_cell(c: Text) -> Column:
    """True for text that is a JSON object or array and nothing more."""

    @F.arrow_udf("boolean")
    def test(cells: pa.Array) -> pa.Array:
        return pa.array([t is not None and container(t) is not None for t in cells.to_pylist()])

    return test(_on_json(c))


def json_kind(c: Text) -> Column:
    """'empty' for null, 'json' for any JSON value, else 'text'."""

    def is_value(text: str | None) -> bool:
        try:
            json.loads(text)
        except (TypeError, ValueError, RecursionError):
            return False
        return True

    @F.arrow_udf("boolean")
    def test(cells: pa.Array) -> pa.Array:
        return pa.array([t is not None and is_value(t) for t in cells.to_pylist()])

    candidate = F.when(_col(c).rlike(_SCALAR), _col(c))
    return F.when(_col(c).isNull(), "empty").when(test(candidate), "json").otherwise("text")


def json_keys(c: Text) -> Column:
    """Top-level keys of a JSON cell; null for any other cell."""

    @F.arrow_udf("array<string>")
    def keys(cells: pa.Array) -> pa.Array:
        documents = (container(t) for t in cells.to_pylist())
        return pa.array([None if d is None else top_keys(d) for d in documents], type=KEYS_TYPE)

    return keys(_on_json(c))


def json_leaves(
    c: Text,
    translate_keys: tuple[str, ...] = TRANSLATE_KEYS,
    skip_keys: tuple[str, ...] = SKIP_KEYS,
) -> Column:
    """Leaves of a JSON cell as (leaf_ord, path, text); null for any other cell."""
    translate, skip = frozenset(translate_keys), frozenset(skip_keys)

    @F.arrow_udf("array<struct<leaf_ord:int,path:string,text:string>>")
    def leaves(cells: pa.Array) -> pa.Array:
        found = [None if t is None else leaves_of(t, translate, skip) for t in cells.to_pylist()]
        return pa.array(found, type=LEAF_TYPE)

    return leaves(_on_json(c))


def json_rebuild(
    c: Text,
    pieces: Column,
    translate_keys: tuple[str, ...] = TRANSLATE_KEYS,
    skip_keys: tuple[str, ...] = SKIP_KEYS,
) -> Column:
    """The JSON cell with ``pieces`` (leaf_ord, tgt) put in; null for other cells."""
    translate, skip = frozenset(translate_keys), frozenset(skip_keys)

    @F.arrow_udf("string")
    def rebuild(cells: pa.Array, found: pa.Array) -> pa.Array:
        pairs = zip(cells.to_pylist(), found.to_pylist())
        return pa.array(
            [None if t is None else rebuilt(t, p, translate, skip) for t, p in pairs],
            type=pa.string(),
        )

    return rebuild(_on_json(c), F.when(looks_json(c), pieces))
