"""JSON cells: detection, leaves, rebuilding."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from glossa.functions import jsoncell
from glossa.functions.jsoncell import container, leaves_of, rebuilt, top_keys
from glossa.operators.cells import route_cell
from glossa.operators.leaves import explode_json_leaves, leaf_table
from glossa.settings import SKIP_KEYS, TRANSLATE_KEYS

T, S = frozenset(TRANSLATE_KEYS), frozenset(SKIP_KEYS)

CHAT = (
    '[{"role":"user","content":"What is AI?"},{"role":"assistant","content":"AI is…"}]'
)
CELLS = [
    (CHAT, ["What is AI?", "AI is…"]),
    (
        '{"metadata":{"content":"no"},"messages":[{"content":"yes","id":"x"}],"title":"keep"}',
        ["yes"],
    ),
    ('{"text":["bare","strings"]}', []),
    ('{"content":{"text":"deep"},"n":1.0,"z":null}', ["deep"]),
    ('{"b":1,"a":2}', []),
    ('{"a":1,"a":2}', []),
    ('{"content":"  "}', []),
    ('{"k": 69}', []),
    ("[]", []),
    ("{}", []),
    ('  {"x":NaN}\n', []),
    ('{"text":"a","items":[{"text":"b","sub":{"answer":"c"}},[{"output":"d"}]],"input":"e"}',
     ["a", "b", "c", "d", "e"]),
    ('"str"', None),
    ("12", None),
    ("true", None),
    ("null", None),
    ('{"a":1} x', None),
    ("{'a':1}", None),
    ("[1", None),
    ("nope", None),
    ("", None),
    ("  ", None),
    (None, None),
]


def frame(spark):
    return spark.createDataFrame([(i, c) for i, (c, _) in enumerate(CELLS)], "id int, cell string")


def test_is_json_cell(spark):
    got = frame(spark).select("id", jsoncell.is_json_cell("cell").alias("j")).orderBy("id").collect()
    assert [r.j for r in got] == [leaves is not None for _, leaves in CELLS]


def test_leaves(spark):
    got: dict[int, list] = {}
    for r in explode_json_leaves(frame(spark), "cell").collect():
        got.setdefault(r.id, []).append((r.leaf_ord, r.text))
    for i, (_, want) in enumerate(CELLS):
        assert sorted(got.get(i, [])) == list(enumerate(want or []))


def test_paths():
    text = '{"a.b":[{"text":"x"}],"content":"y","n":{"text":"z"}}'
    assert [leaf["path"] for leaf in leaves_of(text, T, S)] == [
        '$."a.b"[0].text',
        "$.content",
        "$.n.text",
    ]


def test_leaf_table_takes_plain_cells_whole(spark):
    rows = leaf_table(frame(spark)).collect()
    plain = {r.text for r in rows if r.path == "$"}
    assert plain == {c for c, leaves in CELLS if leaves is None and c and c.strip()}
    off = leaf_table(frame(spark), "off").collect()
    assert {r.text for r in off} == {c for c, _ in CELLS if c and c.strip()}


def test_routes(spark):
    cell = F.col("cell")
    got = frame(spark).select(
        "id", *(route_cell(cell, m).alias(m) for m in ("auto", "force", "off"))
    ).orderBy("id").collect()
    for r, (c, leaves) in zip(got, CELLS):
        blank = c is None or not c.strip()
        assert r.auto == r.force == ("skip" if blank else "plain" if leaves is None else "json")
        assert r.off == ("skip" if blank else "plain")


def test_kinds(spark):
    cells = ["x", "12", "-1.5", "true", '"s"', " null ", "{}", "", None, "12 x", "trueish", "{"]
    df = spark.createDataFrame(list(enumerate(cells)), "id int, cell string")
    got = df.select("id", jsoncell.json_kind("cell").alias("k")).orderBy("id").collect()
    kinds = "text json json json json json json text empty text text text".split()
    assert [r.k for r in got] == kinds


def pieces(leaves, sign="[tr] "):
    return [{"leaf_ord": leaf["leaf_ord"], "tgt": sign + leaf["text"]} for leaf in leaves]


def test_rebuild_keeps_form():
    got = rebuilt(CHAT, pieces(leaves_of(CHAT, T, S)), T, S)
    assert got == (
        '[\n  {\n    "role": "user",\n    "content": "[tr] What is AI?"\n  },\n'
        '  {\n    "role": "assistant",\n    "content": "[tr] AI is…"\n  }\n]'
    )
    assert rebuilt('{"a":1,"a":2}', [], T, S) == '{\n  "a": 2\n}'
    assert rebuilt('{"b":1.0,"a":null}', None, T, S) == '{\n  "b": 1.0,\n  "a": null\n}'
    assert rebuilt("nope", [], T, S) is None


def test_rebuild_joins_chunks_and_keeps_failed_leaves():
    text = '{"text":"a b","answer":"c d"}'
    found = [
        {"leaf_ord": 0, "tgt": "A"},
        {"leaf_ord": 0, "tgt": "B"},
        {"leaf_ord": 1, "tgt": "C"},
        {"leaf_ord": 1, "tgt": None},
    ]
    assert json.loads(rebuilt(text, found, T, S)) == {"text": "A B", "answer": "c d"}


def test_half_surrogates_do_not_stop_a_job(spark):
    cell = r'{"content":"a\ud800b","k":"\udc00"}'
    df = spark.createDataFrame([(0, cell)], "id int, cell string")
    assert explode_json_leaves(df, "cell").first().text == "a�b"
    out = df.select(jsoncell.json_rebuild("cell", F.lit(None).cast(
        "array<struct<leaf_ord:int,tgt:string>>"))).first()[0]
    assert json.loads(out) == json.loads(cell)


def test_deep_nesting_is_no_error():
    deep = "[" * 100_000 + "]" * 100_000
    assert container(deep) is None
    nested = '{"x":' * 300 + '{"text":"t"}' + "}" * 300
    assert [leaf["text"] for leaf in leaves_of(nested, T, S)] == ["t"]


def random_document(pick: random.Random, depth: int = 0):
    kind = pick.randrange(7 if depth < 4 else 4)
    if kind < 2:
        return pick.choice(["", " ", "text", "Ünï \"q\"\n", "{}", "😀"])
    if kind == 2:
        return pick.choice([1, 1.5, -0.0, 1e300, 10**20, True, False, None])
    if kind == 3:
        return pick.choice(["content", "role"])
    if kind < 6:
        keys = ["content", "text", "role", "metadata", "x", "a.b", "answer", "id"]
        return {k: random_document(pick, depth + 1) for k in pick.sample(keys, pick.randrange(5))}
    return [random_document(pick, depth + 1) for _ in range(pick.randrange(4))]


def translated_by_the_rule(node):
    if isinstance(node, list):
        return [translated_by_the_rule(v) for v in node]
    if not isinstance(node, dict):
        return node
    done = {}
    for k, v in node.items():
        if k in S:
            done[k] = v
        elif isinstance(v, str) and k in T and v.strip():
            done[k] = f"[tr] {v}"
        else:
            done[k] = translated_by_the_rule(v)
    return done


@pytest.mark.parametrize("seed", range(5))
def test_random_documents(spark, seed):
    pick = random.Random(seed)
    docs = [[random_document(pick)] for _ in range(100)]
    df = spark.createDataFrame(
        [(i, json.dumps(d, ensure_ascii=bool(i % 2))) for i, d in enumerate(docs)],
        "id int, cell string",
    )
    found = F.transform(
        jsoncell.json_leaves("cell"),
        lambda x: F.struct(
            x["leaf_ord"].alias("leaf_ord"), F.concat(F.lit("[tr] "), x["text"]).alias("tgt")
        ),
    )
    out = df.withColumn("p", found).select(
        "id", jsoncell.json_rebuild("cell", F.col("p")).alias("o")
    )
    for r in out.collect():
        want = translated_by_the_rule(docs[r.id])
        assert r.o == json.dumps(want, ensure_ascii=False, indent=2)


def test_top_keys():
    assert top_keys(container('[{"b":1},{"a":{"z":1}},[{"no":1}],3]')) == ["a", "b"]
    assert top_keys(container('{"x":{"y":1}}')) == ["x"]
