"""Text functions, against the documented examples and a plain rule in Python."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from glossa.functions import text as tx
from glossa.functions.deep import deep_chunks, shallow_chunks
from glossa.operators.chunks import chunk_table, join_chunks
from glossa.settings import (
    PROMPT_PRESETS,
    SKIP_KEYS,
    SPACE_CHARS,
    TRANSLATE_KEYS,
    JobParams,
    char_budget,
)


def column(spark, values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id int, t string")


def collect(df, c):
    return [r[0] for r in df.orderBy("id").select(c).collect()]


def test_space_is_pythons_space():
    assert set(SPACE_CHARS) == {chr(i) for i in range(0x110000) if chr(i).isspace()}


def test_estimate_tokens(spark):
    df = column(spark, ["", None, "a", "abcd", "abcdefg", "abcdefgh", "a😀é…"])
    assert collect(df, tx.estimate_tokens("t")) == [0, 0, 1, 1, 1, 2, 1]


@pytest.mark.parametrize("max_tokens", [1, 2, 3, 5, 128, 512])
def test_char_budget_is_the_limit_of_the_estimate(spark, max_tokens):
    budget = char_budget(max_tokens)
    df = column(spark, ["x" * n for n in range(max(budget - 2, 0), budget + 3)])
    rows = df.select(F.length("t").alias("n"), tx.fits_limit("t", max_tokens).alias("ok")).collect()
    assert all(r.ok == (r.n <= budget) for r in rows)


def test_blank_and_cell_text(spark):
    df = column(spark, [None, "", "  ", "\x1e　\n", "a", "  b"])
    assert collect(df, tx.is_translatable("t")) == [False, False, False, False, True, True]
    assert collect(df, tx.cell_text("t")) == ["", "", "  ", "\x1e　\n", "a", "  b"]
    assert collect(df.where("id > 0"), tx.strip("t")) == ["", "", "", "a", "b"]
    numbers = spark.createDataFrame([(0, 5), (1, None)], "id int, t int")
    assert collect(numbers, tx.cell_text("t")) == ["5", ""]


def test_doubles_look_as_in_python(spark):
    pick = random.Random(5)
    values = [0.0, -0.0, 1.0, 1e7, 12345678.9, 1e15, 9999999999999998.0, 1e16, 1.5e300, 1e-3, 1e-4]
    values += [0.00012345678901234567, 1e-5, -2.5e-7, float("inf"), float("-inf"), 123456.789]
    values += [pick.uniform(-1, 1) * 10.0 ** pick.randrange(-12, 22) for _ in range(500)]
    df = spark.createDataFrame(list(enumerate(values)), "id int, x double")
    for r in df.select("x", tx.double_text("x").alias("t")).collect():
        # Older Java versions print a digit or two more than needed now and then.
        assert float(r.t) == r.x and ("e" in r.t) == ("e" in repr(r.x))
        assert r.t == repr(r.x) or 1 <= len(r.t) - len(repr(r.x)) <= 2
    nan = spark.createDataFrame([(0, float("nan")), (1, None)], "id int, x double")
    assert [r.t for r in nan.select(tx.double_text("x").alias("t")).collect()] == [None, None]


CHUNK_CASES = [
    ("Fits.", 8, ["Fits."]),
    ("   ", 1, ["   "]),
    ("aa bb. cc dd. ee ff gg hh. ii.", 4, ["aa bb. cc dd.", "ee ff gg hh.", "ii."]),
    (
        "One two three four five six seven eight nine ten.",
        8,
        ["One two three four five", "six seven eight nine ten."],
    ),
    (
        "Short. alpha beta gamma delta epsilon zeta eta theta. End.",
        8,
        ["Short.", "alpha beta gamma delta", "epsilon zeta eta theta.", "End."],
    ),
    ("supercalifragilisticexpialidocious", 4, ["supercalifragilisticexpialidocious"]),
    ("a; b: c, d", 1, ["a;", "b:", "c,", "d"]),
    (
        "\n\nPara one is here.\n\n\nPara two is here.",
        4,
        ["Para one", "is here.", "Para two", "is here."],
    ),
    ("Hi!  Bye? Ok.", 2, ["Hi!", "Bye?", "Ok."]),
    ("Hi!\x1eBye?", 2, ["Hi!", "Bye?"]),
]


@pytest.mark.parametrize(("text", "max_tokens", "want"), CHUNK_CASES)
def test_chunks_of_examples(spark, text, max_tokens, want):
    df = column(spark, [text])
    got = chunk_table(df, "t", max_tokens).orderBy("chunk_idx").collect()
    assert [r.chunk for r in got] == want
    assert [r.chunk_idx for r in got] == list(range(len(want)))
    assert deep_chunks(text, char_budget(max_tokens)) == want


def random_texts(count: int, seed: int) -> list[str]:
    pick = random.Random(seed)
    words = ["a", "ab", "word", "größer", "😀", "x" * 30, "Ünï", "don't", "1,5"]
    gaps = [" ", " ", " ", "  ", "\n", "\n\n", " ", "\x1e", "\t", " \n "]
    marks = ["", "", "", ".", "!", "?", ",", ";", ":", "..."]
    texts = []
    for _ in range(count):
        n = pick.randrange(0, 60)
        body = "".join(pick.choice(words) + pick.choice(marks) + pick.choice(gaps) for _ in range(n))
        texts.append(pick.choice(["", " ", "\n\n", " " * 40]) + body)
    return texts


@pytest.mark.parametrize("max_tokens", [1, 2, 4, 8, 20, 64])
def test_chunks_of_any_text(spark, max_tokens):
    budget = char_budget(max_tokens)
    texts = random_texts(250, max_tokens)
    df = column(spark, texts).repartition(3)
    got: dict[int, list] = {}
    for r in chunk_table(df, "t", max_tokens).collect():
        got.setdefault(r.id, []).append((r.chunk_idx, r.chunk))
    native = df.select("id", shallow_chunks(F.col("t"), max_tokens).alias("c")).collect()
    alone = {r.id: r.c for r in native if r.c is not None}
    assert alone, "some texts stay in the JVM"
    for i, t in enumerate(texts):
        found = [c for _, c in sorted(got[i])]
        assert " ".join(found).split() == t.split(), "no word is lost, split or moved"
        assert deep_chunks(t, budget) == found, "Python and the JVM agree"
        assert alone.get(i, found) == found
        if t.strip() and len(t) > budget:
            assert all(len(c) <= budget or len(c.split()) == 1 for c in found)
            assert all(c.strip() for c in found)
        else:
            assert found == [t]


def test_chunks_are_as_full_as_sentences_allow():
    pick = random.Random(5)
    for _ in range(100):
        sentences = [f"{'ab ' * pick.randrange(1, 8)}end{i}." for i in range(40)]
        budget = pick.randrange(40, 120)
        chunks = deep_chunks(" ".join(sentences), budget)
        left = iter(sentences)
        for chunk, following in zip(chunks, [*chunks[1:], None]):
            taken = []
            while " ".join(taken) != chunk:
                taken.append(next(left))
            assert len(chunk) <= budget
            if following:
                first = following[: following.index(".") + 1]
                assert len(f"{chunk} {first}") > budget


@pytest.mark.parametrize(
    "text, budget, want",
    [
        ("One. Two. Three.", 9, ["One. Two.", "Three."]),
        ("aa bb\n\ncc dd\nee", 8, ["aa bb", "cc dd\nee"]),
        ("a, b; c d e f", 7, ["a, b;", "c d e f"]),
        ("one two three four five", 9, ["one two", "three", "four five"]),
        ("  lead. tail  ", 7, ["  lead.", "tail  "]),
        ("x" * 30 + " y", 10, ["x" * 30, "y"]),
        ("a" + " " * 20 + "b", 10, ["a b"]),
        ("one, two three four. Five.", 12, ["one,", "two", "three four.", "Five."]),
    ],
)
def test_deep_chunks(text, budget, want):
    assert deep_chunks(text, budget) == want


def test_null_text_stays_null(spark):
    got = chunk_table(column(spark, [None]), "t", 8).collect()
    assert [(r.chunk_idx, r.chunk, r.est_tokens) for r in got] == [(0, None, 0)]


def test_join_chunks_orders_by_index(spark):
    df = spark.createDataFrame(
        [(1, i, f"c{i}") for i in reversed(range(12))], "id int, chunk_idx int, c string"
    )
    assert join_chunks(df, ["id"], "c").first().text == " ".join(f"c{i}" for i in range(12))


def test_chunking_parses_each_text_once(spark):
    plan = chunk_table(column(spark, ["x"]), "t", 8)._jdf.queryExecution().executedPlan().toString()
    assert "Filter" not in plan


def test_prompts(spark):
    df = column(spark, ["use {src} and {text} {0}"])
    system, template = PROMPT_PRESETS["general"]
    got = collect(df, tx.render_prompt("t", "en", "tr", system, template))[0]
    assert [m.role for m in got] == ["system", "user"]
    assert got[0].content.startswith("Above, you see a text in en. Please translate it to tr.")
    assert got[1].content == "use {src} and {text} {0}"
    system, template = PROMPT_PRESETS["translation_model"]
    got = collect(df, tx.render_prompt("t", "en", "tr", system, template))[0]
    assert [(m.role, m.content) for m in got] == [("user", "en to tr: use {src} and {text} {0}")]


def test_key_lists(spark):
    df = column(spark, [" a, b ,, c", "", " , ", None])
    default = list(TRANSLATE_KEYS)
    assert collect(df, tx.parse_key_list("t")) == [["a", "b", "c"], default, default, default]
    assert collect(df, tx.parse_key_list("t", SKIP_KEYS))[1] == list(SKIP_KEYS)


def test_names(spark):
    df = spark.createDataFrame([(0, "org/data\\x", "train")], "id int, d string, s string")
    row = df.select(tx.job_key("d", "s").alias("k"), tx.safe_name("d").alias("n")).first()
    assert row.n == "org_data_x" == tx.safe_name_of("org/data\\x")
    import hashlib

    assert row.k == hashlib.sha256(b"org/data\\x::train").hexdigest()[:12]


@pytest.mark.parametrize(
    "wrong",
    [
        {"source_lang": "xx"},
        {"target_lang": "ko"},
        {"max_tokens": 127},
        {"max_tokens": 32769},
        {"json_mode": "maybe"},
    ],
)
def test_parameters_are_checked(wrong):
    with pytest.raises(ValueError):
        JobParams(**wrong)


def test_scope_depends_on_what_the_model_sees():
    base = JobParams()
    others = [
        JobParams(target_lang="de"),
        JobParams(system_prompt=""),
        JobParams(model="m2"),
        JobParams(max_tokens=512),
    ]
    assert len({p.scope for p in [base, *others]}) == 5
    assert JobParams(json_mode="off").scope == base.scope
