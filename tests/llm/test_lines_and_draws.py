"""Line dedup, whitening and importance resampling against plain Python."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from glossa.llm import importance, line_dedup, whitening
from glossa.llm.spectrum import above, leading

#: Names that the operators add or use themselves, as columns of the input.
CLASHING = (
    "doc_id long, text string, n_lines string, KEPT string, n_dropped string, _lines string, "
    "_r1 string, _at string, _h1 string, buckets string, score string, rank string"
)
WORDS = ["alpha", "Beta", "ümlaut", "x1", "don't", "a-b", "ß", "中文", "42", "end.", "\x1cno", "é\xa0è"]


def table(spark, rows, parts=3):
    return spark.createDataFrame([(*r, *["x"] * 10) for r in rows], CLASHING).repartition(parts)


def lines_by_hand(rows, least, chars):
    small = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    key = lambda line: line.translate(small).strip(" \t\n\x0b\x0c\r")
    held = defaultdict(set)
    for doc_id, text in rows:
        for line in (text or "").split("\n"):
            held[key(line)].add(doc_id)
    gone = {k for k, docs in held.items() if len(docs) >= least and len(k) >= chars}
    out = []
    for doc_id, text in rows:
        lines = (text or "").split("\n")
        kept = [line for line in lines if key(line) not in gone]
        out.append((doc_id, text, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def line_rows():
    rng = random.Random(5)
    lines = ["Footer ", "footer", "\tFOOTER\r", "FÜSSE", "füsse", "Füsse", " ", "", "a\x0bb", "A\x0bB"]
    lines += [f"line {i}" for i in range(30)]
    rows = [(i, "\n".join(rng.choice(lines) for _ in range(rng.randrange(1, 25)))) for i in range(80)]
    rows += [(90, None), (91, ""), (92, "\n"), (93, "\n\nfooter\n"), (None, "footer\nline 1"), (None, "once")]
    rows += [(94, "only repeated\nkeep " + str(i)) for i in range(12)]  # one document, twelve rows
    rows += [(95, "x\nfooter"), (95, "x\nfooter")]
    rows += [(96, "\n".join(["footer", "own line"] * 20_000)), (97, "word " * 100_000)]
    return rows + [(None, "same text\nfooter")] * 40


@pytest.mark.parametrize("least, chars, broadcast", [(10, 1, 300_000), (3, 0, 0), (2, 6, 0), (1, 1, 300_000)])
def test_lines_against_plain_python(spark, monkeypatch, least, chars, broadcast):
    monkeypatch.setattr(line_dedup, "BROADCAST_HASHES", broadcast)
    monkeypatch.setattr(line_dedup, "HOT_LINES", 20)
    rows = line_rows()
    made = line_dedup.drop_repeated_lines(table(spark, rows), min_documents=least, min_chars=chars)
    assert set(made.columns) == {
        "doc_id", "text", "n_lines", "n_dropped", "kept", "_lines", "_r1", "_at", "_h1", "buckets", "score", "rank",
    }
    found = made.select("doc_id", "text", "n_lines", "n_dropped", "kept").collect()
    assert sorted(map(tuple, found), key=str) == lines_by_hand(rows, least, chars)


def test_lines_of_no_rows_and_other_ids(spark):
    assert line_dedup.drop_repeated_lines(table(spark, [])).count() == 0
    rows = [(f"d{i}", "shared\nown " + str(i)) for i in range(3)]
    named = spark.createDataFrame(rows, "id string, body string")
    made = line_dedup.drop_repeated_lines(named, min_documents=3, doc_id="id", text="body")
    assert {r["kept"] for r in made.collect()} == {"own 0", "own 1", "own 2"}


def test_lines_run_no_python(spark):
    plan = line_dedup.drop_repeated_lines(table(spark, line_rows()[:50]))
    assert not re.search("Python|Arrow|Pandas", plan._jdf.queryExecution().executedPlan().toString())


def features_by_hand(text, runs):
    small = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", small)
    return words, [" ".join(words[i : i + n]) for n in range(1, runs + 1) for i in range(len(words) - n + 1)]


def draw_by_hand(rows, target, runs, buckets, percent, least, seed):
    place = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = Counter(), Counter()
    for _, text in rows:
        s.update(map(place, features_by_hand(text, runs)[1]))
    for text in target:
        t.update(map(place, features_by_hand(text, runs)[1]))
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = {
        b: math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets))))
        for b in range(buckets)
    }
    out = []
    for doc_id, text in rows:
        words, found = features_by_hand(text, runs)
        weight = sum(gain[place(f)] for f in found)
        h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        noise = math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([doc_id, len(words), len(found), weight, weight + noise, None])
    able = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    for i, r in enumerate(able[: len(able) * percent // 100]):
        r[5] = i + 1
    return sorted(map(tuple, out), key=str)


def draw_rows():
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choice(WORDS) for _ in range(rng.randrange(0, 60)))) for i in range(150)]
    rows += [(200, None), (201, ""), (202, " ?! "), (None, "alpha beta " * 12), (203, "z" * 5_000 + " alpha" * 30)]
    rows += [(204, "42 " * 40_000), (7, "alpha " * 25), (7, "alpha " * 25)]
    return rows


@pytest.mark.parametrize("runs, buckets, percent, least", [(1, 10_000, 10, 20), (3, 50, 100, 0), (2, 7, 33, 5)])
def test_draw_against_plain_python(spark, runs, buckets, percent, least):
    rows, target = draw_rows(), ["alpha 42 beta", None, "", "Alpha x1 x1"]
    there = spark.createDataFrame([(t,) for t in target], "text string")
    made = importance.resample(
        table(spark, rows), there, runs=runs, buckets=buckets, percent=percent, min_words=least
    )
    found = sorted(map(tuple, made.collect()), key=str)
    assert found == draw_by_hand(rows, target, runs, buckets, percent, least, 2024)
    kept = importance.drawn(table(spark, rows), made)
    ids = {r[0] for r in found if r[5]}
    assert {r["doc_id"] for r in kept.select("doc_id").collect()} == ids


def test_draw_of_no_rows_and_no_target(spark):
    nothing = spark.createDataFrame([], "text string")
    assert importance.resample(table(spark, []), nothing).count() == 0
    rows = draw_rows()[:30]
    made = importance.resample(table(spark, rows), nothing, percent=50)
    assert sorted(map(tuple, made.collect()), key=str) == draw_by_hand(rows, [], 1, 10_000, 50, 20, 2024)
    with pytest.raises(ValueError):
        importance.resample(table(spark, rows), nothing, buckets=0)


def test_matrices_give_the_crc_of_every_feature():
    rng = random.Random(7)
    features = [rng.randbytes(rng.choice([0, 1, 2, 5, 9, 40, 512, 513, 3_000])) for _ in range(400)]
    assert importance.crc_matrix(features).tolist() == [zlib.crc32(f) for f in features]
    assert importance.crc_matrix([]).tolist() == []


def covariances():
    rng = np.random.default_rng(3)
    some = rng.normal(size=(300, 30))
    turn = np.linalg.qr(rng.normal(size=(30, 30)))[0]
    close = np.r_[9, 9 - 1e-9, 9 - 1e-13, 4, 4, 4, np.linspace(1, 2, 24)]
    yield some.T @ some
    yield (turn * close) @ turn.T
    yield np.diag([3.0, 3, 2, 0, 0, 7])
    yield np.zeros((4, 4))
    yield np.array([[2.5]])
    yield np.outer(some[0], some[0])
    scaled = some * np.logspace(-5, 5, 30)
    yield scaled.T @ scaled


@pytest.mark.parametrize("which", range(7))
def test_leading_eigenvalues(which):
    v = list(covariances())[which]
    right = np.linalg.eigvalsh(v)[::-1]
    size = max(float(right[0]), 1e-300)
    values, vectors = leading(v, 16)
    assert len(values) == min(16, int((right > 1e-12 * size).sum()))
    assert np.allclose(values, right[: len(values)], rtol=0, atol=1e-12 * size)
    assert np.abs(v @ vectors - vectors * values).max(initial=0) < 1e-12 * size
    assert np.abs(vectors.T @ vectors - np.eye(len(values))).max(initial=0) < 1e-12
    for shift in np.linspace(-0.1, 1.1, 13) * size + size / 977:
        assert above(v, shift) == int((right > shift).sum())


def vector_rows():
    rng = np.random.default_rng(4)
    base = rng.normal(size=(200, 6)) * [5, 4, 3, 2, 1, 0.5]
    rows = [(i, [float(x) for x in np.float32(v)]) for i, v in enumerate(base)]
    rows += [(i, rows[0][1]) for i in range(300, 360)] + [(5, rows[9][1]), (None, rows[3][1])]
    rows += [(400, None), (401, []), (402, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (403, [float("nan")] * 6)]
    rows += [(404, [float("inf")] * 6), (405, [3e30] * 6)]
    rows += [(500 + i, [float(x) for x in np.float32(rng.normal(size=3))]) for i in range(20)]
    return rows + [(600, [1.0, 2.0]), (601, [1.0, 2.0])]


def floored(c):
    return F.when(F.abs(64 * c) < 2.0**51, F.floor(64 * c).cast("double") + 1_000_000)


def test_whitening_against_numpy(spark):
    rows = vector_rows()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4)
    found = whitening.whiten(df, components=4, component=floored).collect()
    made = defaultdict(list)
    for r in found:
        made[r["component"]].append(r)
    by_size = defaultdict(list)
    for i, v in rows:
        if v and all(x is not None and abs(x) < 1e20 for x in v):
            by_size[len(v)].append((i, [math.floor(64 * x) + 1_000_000 for x in v]))
    assert len(found) == 4 * len(by_size[6]) + 3 * len(by_size[3])  # two equal vectors do not vary
    for size, k in ((6, 4), (3, 3)):
        once = sorted({tuple(x) for _, x in by_size[size]})
        n, sums = len(once), [sum(c) for c in zip(*once)]
        y = np.array([[(n * a - s) / n for a, s in zip(x, sums)] for x in once])
        values, vectors = np.linalg.eigh(y.T @ y / n)
        values, vectors = values[::-1], vectors[:, ::-1]
        mine = [r for r in found if r["n"] == n]
        assert len(mine) == k * len(by_size[size])
        whole = defaultdict(set)
        for i, x in by_size[size]:
            whole[i].add(sum((n * a - s) ** 2 for a, s in zip(x, sums)))
        signs = {}
        for r in mine:
            assert r["deviation"] in whole[r["vec_id"]]
            c = r["component"] - 1
            assert math.isclose(r["explained"], values[c] / values.sum(), rel_tol=1e-9)
            assert 0 <= r["identity_error"] < 1e-9
            choices = [
                float(((np.array(x) - np.array(sums) / n) @ vectors[:, c]) / math.sqrt(values[c]))
                for i, x in by_size[size] if i == r["vec_id"]
            ]
            sign = signs.setdefault(c, math.copysign(1, r["whitened"] * choices[0]))
            assert any(math.isclose(r["whitened"], sign * w, rel_tol=1e-6, abs_tol=1e-7) for w in choices)


def test_whitening_of_few_vectors(spark):
    kind = "vec_id long, embedding array<double>"
    none = whitening.whiten(spark.createDataFrame([], kind), component=floored)
    assert none.count() == 0 and none.columns[0] == "vec_id"
    one = spark.createDataFrame([(1, [1.0, 2.0])], kind)
    assert whitening.whiten(one, component=floored).count() == 0
    two = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 3.0]), (2, [1.0, 3.0])], kind)
    found = whitening.whiten(two, component=floored).collect()
    assert [r["component"] for r in found] == [1, 1, 1]
    assert {round(abs(r["whitened"]), 12) for r in found} == {1.0}
    assert {r["deviation"] for r in found} == {64 * 64} and {r["n"] for r in found} == {2}


def test_deviations_beyond_a_long():
    how = whitening.Whitening(3, [0, 0], np.ones(1), np.ones((2, 1)), 1.0)
    x = np.array([[1 << 40, 0], [10**9, 10**8], [3, 4]])
    exact = [sum((3 * int(a)) ** 2 for a in row) for row in x]
    assert how.deviations(x) == [None, exact[1], 225]
