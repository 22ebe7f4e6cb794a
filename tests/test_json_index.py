"""The structural index against the standard parser."""

import json
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tarnwork.functions.json_index import index
from tarnwork.operators.nested import array_objects, elements, unnest, unwrap_twice_encoded


def brute(text, column="c", twice=False):
    def refuse(_):
        raise ValueError

    try:
        value = json.loads(text, parse_constant=refuse)
        if twice and isinstance(value, str):
            value = json.loads(value, parse_constant=refuse)
    except (ValueError, TypeError):
        return []
    out = []

    def walk(x, path, parent, in_array):
        if isinstance(x, dict):
            if in_array:
                kind = x.get("type")
                out.append((path, parent, kind if isinstance(kind, str) else ""))
                parent = path
            for k, y in x.items():
                walk(y, f"{path}.{k}", parent, False)
        elif isinstance(x, list):
            for i, y in enumerate(x):
                walk(y, f"{path}[{i}]", parent, True)

    walk(value, column, "", False)
    return out


def found(texts, twice=False):
    array = pa.array(texts, pa.string())
    rows = elements(index(unwrap_twice_encoded(array) if twice else array), "c")
    out = {k: [] for k in range(len(texts))}
    for doc, *row in zip(rows["doc"].tolist(), *[rows[k].to_pylist() for k in ("item_path", "parent_path", "item_type")]):
        out[doc].append(tuple(row))
    return [sorted(v) for v in out.values()]


EDGES = [
    None, "", " ", "[]", "[{}]", '[[{}],{"a":[{}]}]', '{"a":1}', "nul", "[1,]", '[{"type":"x\\u0041\\""}]', "[{},{}]]", "[NaN]", '[{"a":01}]', '{"k\\n.":[{"type":5}]}', '[{"é":[{"type":"ü😀"}]}]',
    '[ { "type" : "a" } , { } ]', '{"a":{"b":[1,"x",{"id":"q"},[],{}]}}', '["a" "b"]', '{"a" 1}', "{1:2}", "[1 2]", "\\", '"\\', "[{}]\\", '"abc', "[tru]", '[{"a":"\x01"}]', '[{"a":"\\x"}]', '[{"a":"\\u12g4"}]', '[{"a":{"type":"inner"},"type":"outer"}]', "[" * 200 + "{}" + "]" * 200, '{"a":[{}],}', "[{}]x", '[{"type":"a"}]' * 2,
]


def test_edges():
    assert found(EDGES) == [sorted(brute(t)) if t is not None else [] for t in EDGES]


def test_mutated_texts():
    dice = random.Random(5)
    base = ['{"role":"user","content":[{"type":"text","text":"a \\"b\\" {c}"},{"type":"tool_use","id":"t1","input":{"edits":[{"old":"[x]"},{"new":null}]}}],"n":-1.5e3}', '[{"a":[[{"type":"q"}]]},true,false,{"type":"z","l":[1,{"m":[]}]}]']
    texts = []
    for _ in range(1500):
        chars = list(dice.choice(base))
        for _ in range(dice.randint(0, 3)):
            at = dice.randrange(len(chars))
            chars[at : at + dice.randint(0, 1)] = dice.choice(list('{}[]:,"\\ 01atné') + [""])
        texts.append("".join(chars))
    assert found(texts) == [sorted(brute(t)) for t in texts]


def test_twice_encoded():
    inner = '[{"type":"x"}]'
    texts = [json.dumps(inner), json.dumps(json.dumps(inner)), " " + json.dumps(inner), '"plain"', '"bad']
    assert found(texts, twice=True) == [sorted(brute(t, twice=True)) for t in texts]


@pytest.fixture(scope="module")
def lines(spark):
    rows = [
        (1, '{"content":[{"type":"tool_use","id":"a"},{"type":"text"}]}', None, "x"),
        (2, '{"content":[{"type":"tool_result","tool_use_id":"a","content":[{"type":"text"}]}]}', '{"l":[{"type":"tool_use","id":"b"}]}', "x"),
        (3, '{"content":[{"type":"tool_result","tool_use_id":"b"},{"type":"tool_result","tool_use_id":"lost"}]}', "no json", "x"),
        (4, '{"content":[{"type":"tool_use","id":"a"}]}', "", "x"),
        (4, '{"content":[{"type":"tool_use","id":"a"}]}', "", "x"),
        (5, None, None, None),
    ]
    return spark.createDataFrame(rows, "line_id long, message string, tool_use_result string, item_path string")


def test_links(lines):
    got = {(r["row_id"], r["item_path"]): (r["parent_path"], r["use_row_id"]) for r in unnest(lines, id_column="line_id", columns=["message", "tool_use_result"]).collect()}
    assert got[2, "message.content[0]"] == ("", 1)
    assert got[2, "message.content[0].content[0]"] == ("message.content[0]", 0)
    assert got[3, "message.content[0]"] == ("", 2)
    assert got[3, "message.content[1]"] == ("", 0)
    assert (2, "tool_use_result.l[0]") in got


def test_repeated_and_empty(lines):
    rows = array_objects(lines, id_column="line_id", columns=["message"])
    assert rows.filter("row_id = 4").count() == 2
    assert unnest(lines.limit(0), id_column="line_id", columns=["message"]).count() == 0
    assert rows.filter(F.col("row_id") == 5).count() == 0
