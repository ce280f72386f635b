"""Token ids of whole texts with a public tokenizer, a word at a time.

The tokenizers never join a word with the blanks behind it, nor letters with marks, so a
text is cut in front of every run of ASCII blanks, and between a word of plain letters and
the marks that end it; each piece is encoded apart. Blanks are left out if the tokenizer
drops them. Texts are cut many at a time, as arrays of bytes, and each distinct piece among
them is looked up once, so the work for a single word is a few array operations. Pieces
repeat, so a worker remembers the ids of those it saw last, up to a bound. New pieces of
plain letters are encoded many at a time, side by side as in a text; which tokens begin or
end a word says where the ids are cut. Texts with other blanks or separators, on which
tokenizers may disagree, and texts that may hold the name of a special token, are encoded as
a whole.

Ids are those of the plain library: a special token's name in a text is that token, unless
``names_as_text`` says that it is ordinary text.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from glossa.llm.common import worker_state

#: Pieces a worker remembers in each of two generations; with their ids about 60 MB each.
MEMORY = 300_000

#: Pieces encoded side by side.
TOGETHER = 500

#: Bytes of text encoded at once.
BATCH_BYTES = 4_000_000

_BLANKS = " \t\n\r\x0b\x0c"
_MARKS = ".,;:!?$%&#*|"
#: What a byte is. Letters are those of Latin-1 with the two bytes of the accented ones.
_OTHER, _BLANK, _LETTER, _MARK = range(4)
_KINDS = np.zeros(256, np.uint8)
_KINDS[list(_BLANKS.encode())] = _BLANK
_KINDS[[*range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1)]] = _LETTER
_KINDS[list(_MARKS.encode())] = _MARK
#: First byte of À to ÿ, and the second bytes of the two signs among them, × and ÷.
_ACCENTED, _SIGNS = 0xC3, (0x97, 0xB7)
_ODD = (
    "[\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200d\u2028-\u202f\u205f\u2060\u3000\ufeff]"
)


def _bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 of all texts in a row, and where each begins, with the end of the last."""
    _, offsets, data = texts.buffers()
    wide = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    at = np.frombuffer(offsets, wide)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data or b"", np.uint8)[at[0] : at[-1]]
    return raw, at.astype(np.int64) - at[0]


def _cut(raw: np.ndarray, at: np.ndarray, blanks: bool) -> tuple[pa.Array, np.ndarray]:
    """The pieces of texts in a row, and how many there are before each text and in all.

    With ``blanks``, a piece has the blanks in front of it. A run of other characters is one
    piece, or two if it is letters and then marks.
    """
    kind = _KINDS[raw]
    lead = np.flatnonzero(raw == _ACCENTED)
    lead = lead[~np.isin(raw[lead + 1], _SIGNS)]
    kind[lead] = kind[lead + 1] = _LETTER
    starts = at[:-1][at[:-1] < len(raw)]
    behind = np.empty_like(kind)
    behind[1:] = kind[:-1]
    behind[starts] = _BLANK
    blank = kind == _BLANK
    runs = ~blank & (behind == _BLANK)
    if blanks:
        begins = blank & (behind != _BLANK)
        begins[starts] = True
    else:
        begins = runs.copy()
    run_at = np.flatnonzero(runs)
    if len(run_at):
        mixed = (kind == _OTHER) | (kind == _LETTER) & (behind == _MARK)
        mixed = np.logical_or.reduceat(mixed, run_at)
        marks = np.flatnonzero((kind == _MARK) & (behind == _LETTER))
        begins[marks[~mixed[np.searchsorted(run_at, marks, "right") - 1]]] = True
    before = np.searchsorted(np.flatnonzero(begins), at)
    if not blanks:
        raw, begins = raw[~blank], begins[~blank]
    bounds = np.append(np.flatnonzero(begins), len(raw)).astype(np.int32)
    buffers = pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(raw))
    return pa.StringArray.from_buffers(len(bounds) - 1, *buffers), before


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit integers in a byte string."""

    def __init__(self, path: str, names_as_text: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = names_as_text
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        # What a name begins with before its first letter, whatever case the rest is in.
        starts = {re.split(r"[^\W\d_]", name, maxsplit=1)[0] or name for name in special}
        marks = () if names_as_text else map(re.escape, sorted(starts))
        self.whole = "|".join([_ODD, *marks])
        self.known: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}
        bare, *blank = self._encode(["a", *(b + "a" for b in _BLANKS), *("a" + b for b in _BLANKS)])
        drops_blanks = all(b == bare for b in blank)
        self.between = " " if drops_blanks else ""
        self.ends = drops_blanks
        # The blanks that open a word, and how the names of tokens write them.
        for self.opening, written in (" \n", ("\u0120", "\u010a")), (" ", ("\u0120",)):
            self.edge = self._edges(written)
            if self.edge is not None:
                break

    def _edges(self, written: tuple[str, ...]) -> np.ndarray | None:
        """Which ids end a word, or else begin one with its blank; None if tokens do not say."""
        names = self.tokenizer.get_vocab()
        edge = np.zeros(max(names.values()) + 1, bool)
        for name, number in names.items():
            edge[number] = name.endswith("</w>") if self.ends else name.startswith(written)
        words = ["a", "zzxqy", "Übermäßig", "élève", "the", "ÿÿ", "internationalization", "I"]
        pieces = words if self.ends else [b + w for w in words for b in self.opening]
        self.edge = edge
        return edge if self._side_by_side(pieces) == self._encode(pieces) else None

    def _encode(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [array("I", e.ids).tobytes() for e in found]

    def _side_by_side(self, pieces: list[str]) -> list[bytes]:
        """Ids of pieces of letters, each with an edge at least; more are encoded apart."""
        out: list[bytes] = []
        groups = [pieces[i : i + TOGETHER] for i in range(0, len(pieces), TOGETHER)]
        texts = [self.between.join(group) for group in groups]
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        for group, one in zip(groups, found):
            ids = np.array(one.ids, np.uint32)
            cuts = np.flatnonzero(self.edge[ids])
            if len(cuts) != len(group):
                out += self._encode(group)
                continue
            raw, at = ids.tobytes(), (4 * cuts).tolist()
            edges = [0, *(a + 4 for a in at)] if self.ends else [*at, len(raw)]
            out += [raw[a:b] for a, b in zip(edges, edges[1:])]
        return out

    def _plain(self, piece: str) -> bool:
        return piece.isalpha() if self.ends else piece[0] in self.opening and piece[1:].isalpha()

    def _ids(self, pieces: list[str]) -> list[bytes]:
        """Ids of distinct pieces, which are remembered."""
        found = list(map(self.known.get, pieces))
        absent = [p for p, ids in zip(pieces, found) if ids is None]
        if len(self.known) + len(absent) > MEMORY:
            self.known, self.before = dict(zip(pieces, found)), self.known
            for p in absent:
                del self.known[p]
        old = list(map(self.before.get, absent))
        self.known.update((p, ids) for p, ids in zip(absent, old) if ids is not None)
        new = [p for p, ids in zip(absent, old) if ids is None]
        if self.edge is not None:
            plain = [p for p in new if self._plain(p)]
            self.known.update(zip(plain, self._side_by_side(plain)))
            new = list(set(new).difference(plain))
        self.known.update(zip(new, self._encode(new)))
        made = map(self.known.__getitem__, absent)
        return [next(made) if ids is None else ids for ids in found]

    def _in_pieces(self, texts: pa.Array) -> list[bytes]:
        raw, at = _bytes(texts)
        if not len(raw):
            return [b""] * len(texts)
        pieces, before = _cut(raw, at, not self.ends)
        coded = pieces.dictionary_encode()
        found = self._ids(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        codes = coded.indices.to_numpy()
        stored = np.frombuffer(b"".join(found), np.uint32)
        sizes = np.fromiter((len(x) // 4 for x in found), np.int32, len(found))
        # The ids of piece k are ``count[k]`` of the stored ones from its first on.
        count = sizes[codes]
        until = np.append(0, np.cumsum(count))
        step = (np.cumsum(sizes) - sizes)[codes] - until[:-1]
        place = np.repeat(step.astype(np.int32), count)
        place += np.arange(len(place), dtype=np.int32)
        ids = stored[place].tobytes()
        bounds = (4 * until[before]).tolist()
        return [ids[a:b] for a, b in zip(bounds, bounds[1:])]

    def encode(self, texts: list[str] | pa.Array) -> list[bytes]:
        if not isinstance(texts, pa.Array):
            texts = pa.array(texts, pa.string())
        texts = pc.fill_null(texts, "")
        whole = pc.match_substring_regex(texts, self.whole)
        out = self._in_pieces(texts.filter(pc.invert(whole)) if pc.any(whole).as_py() else texts)
        for i in np.flatnonzero(whole.to_numpy(zero_copy_only=False)).tolist():
            out.insert(i, self._encode([texts[i].as_py()])[0])
        return out


def encoder(path: str) -> Encoder:
    """One for each worker process, which Spark uses for many tasks."""
    kept = worker_state()
    if path not in kept:
        kept[path] = Encoder(path)
    return kept[path]


def slices(texts: pa.Array, most: int = BATCH_BYTES) -> Iterator[slice]:
    """Runs of texts with at most that many bytes, or a single longer text."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_pylist()
    start = held = 0
    for i, size in enumerate(sizes):
        if i > start and held + size > most:
            yield slice(start, i)
            start, held = i, 0
        held += size
    if sizes:
        yield slice(start, len(sizes))


def encoded(
    batches: Iterator[pa.RecordBatch], path: str, end_id: int, text: str
) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Small batches, each with the ids of its texts and the end id; null counts as empty."""
    coder = encoder(path)
    ending = end_id.to_bytes(4, "little")
    for batch in batches:
        for part in slices(batch.column(text)):
            some = batch[part]
            yield some, [x + ending for x in coder.encode(some.column(text))]


def with_ids(df: DataFrame, path: str, end_id: int, *, text: str, ids: str = "ids") -> DataFrame:
    """``df`` with the text replaced by its ids and the end id, packed in a binary column.

    A null text counts as empty. The file at ``path`` must be on every executor.
    """
    names = [c for c in df.columns if c not in (text, ids)]
    schema = df.select(*names).schema.add(ids, "binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some, found in encoded(batches, path, end_id, text):
            columns = [*(some.column(n) for n in names), pa.array(found, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, ids])

    return df.select(*names, text).mapInArrow(run, schema)
