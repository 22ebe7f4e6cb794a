"""Encoding, packing, splitting and subjects: brute force, round trips, bounds and edges."""

import os
import random
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tarnwork.llm import splitting
from tarnwork.llm.packing import Capacities, pack, plan
from tarnwork.llm.subjects import Model, assign_subjects, bucket_of, composition, fit, proportions, sentences, terms_of, topic_terms
from tarnwork.llm.tokens import DEFAULT_RANKS, codec, encode_corpus, halves, token_counts

needs_ranks = pytest.mark.skipif(not os.path.exists(DEFAULT_RANKS), reason="no rank file here")
PARTS = ["a", "bc", "'", "'s", "'re", " ", "  ", "\n", "\t\n", "1", "23", "é", "😀", "ÄÖ", "!", "...", "'ll ", "\u00a0", "\u200b", "文字", "the ", "<|endoftext|>"]


@needs_ranks
@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=120), st.sampled_from([5, 17, 64]))
def test_tree_concatenation(parts, leaf):
    text = "".join(parts)
    assert "".join(halves(text, leaf)) == text
    assert codec().encode_long(text, leaf).tolist() == codec().encode(text)


@needs_ranks
@pytest.mark.parametrize("text", ["x" * 40_000, " " * 40_000, "ab1" * 20_000, "don't " * 9_000, "!?" * 20_000])
def test_long_unsplit(text):
    assert codec().encode_long(text, 4096).tolist() == codec().encode(text)


@needs_ranks
def test_encode_corpus(spark):
    long = "naïve café don't " * 3_000
    rows = [(1, "hello world", "x"), (2, "", "x"), (3, None, "x"), (4, long, "x"), (4, long, "x"), (5, "<|endoftext|>", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = sorted((r["doc_id"], list(r["ids"])) for r in encode_corpus(df).collect())
    assert got == sorted((k, codec().encode(t)) for k, t, _ in rows)
    assert {r["doc_id"]: r["n_tokens"] for r in token_counts(df).collect()}[4] == len(codec().encode(long))
    assert encode_corpus(df.limit(0)).count() == 0


@needs_ranks
def test_same_as_other_library():
    tokenizers = pytest.importorskip("tokenizers")
    other = tokenizers.Tokenizer.from_file(os.path.join(os.path.dirname(DEFAULT_RANKS), "byte_bpe_50k.json"))
    other.encode_special_tokens = True
    for text in ["Hello there, it's 12 o'clock.\n\n\tok", "über <|endoftext|> 文字 😀  x", " "]:
        assert other.encode(text, add_special_tokens=False).ids == codec().encode(text)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 100), min_size=1, max_size=80), st.sampled_from([Capacities(tokens=100), Capacities(tokens=100, documents=3), Capacities(tokens=100, attention=5_000), Capacities(tokens=100, score="dot")]))
def test_plan(sizes, capacities):
    if max(sizes) > capacities.largest:
        with pytest.raises(ValueError):  # `pack` cuts such items first
            plan(dict(Counter(sizes)), capacities)
        sizes = [min(s, capacities.largest) for s in sizes]
    bins, seen = defaultdict(list), Counter()
    for length, _, number, first, place, offset in plan(dict(Counter(sizes)), capacities):
        for k in range(number):
            assert sum(bins[first + k]) == offset and len(bins[first + k]) + 1 == place
            bins[first + k].append(length)
            seen[length] += 1
    assert seen == Counter(sizes)
    assert all(sum(b) <= 100 for b in bins.values())
    if capacities.documents:
        assert all(len(b) <= 3 for b in bins.values())
    if capacities.attention:
        assert all(sum(x * x for x in b) <= 5_000 for b in bins.values())  # without exception
    if capacities == Capacities(tokens=100):
        assert len(bins) <= 1.3 * -(-sum(sizes) // 100) + 1


@needs_ranks
def test_pack(spark):
    dice = random.Random(1)
    rows = [(k, "word " * dice.randint(1, 900)) for k in range(300)] + [(900, "word " * 5_000), (901, ""), (902, None), (0, "again")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = pack(df).collect()
    by = defaultdict(list)
    for r in got:
        by[r["container_id"]].append(r)
    for items in by.values():
        items.sort(key=lambda r: r["place"])
        assert [r["place"] for r in items] == list(range(1, len(items) + 1))
        assert [r["container_offset"] for r in items] == [sum(x["n_tokens"] for x in items[:k]) for k in range(len(items))]
        assert sum(r["n_tokens"] for r in items) <= 2048
    assert sorted(by) == list(range(len(by)))
    total = sum(r["n_tokens"] for r in got)
    assert len(by) <= -(-total // 2048) + 1
    parts = sorted((r["piece_no"], r["start_token"], r["n_tokens"]) for r in got if r["doc_id"] == 900)
    assert parts[0] == (1, 0, 2048) and sum(p[2] for p in parts) == len(codec().encode("word " * 5_000))
    assert {r["doc_id"] for r in got} == {*range(300), 900} and sum(r["doc_id"] == 0 for r in got) == 2
    assert pack(df.limit(0)).count() == 0


def pieces_hold(text, kind):
    pieces = splitting.split(text, kind=kind)
    tokens = splitting.count_tokens(text)
    assert (len(pieces) > 1) == (tokens > splitting.LIMIT)
    at = 0
    for start, end, shared, piece, size in pieces:
        assert splitting.count_tokens(piece) == size <= splitting.LIMIT
        assert splitting.count_tokens(text[at:start]) == 0 if start > at else True
        assert 0 <= shared <= splitting.OVERLAP and (shared == 0 or kind not in ("code", "table"))
        assert end > at or not text
        at = end
    assert at == len(text)
    return pieces


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["word ", "Longerword", ". ", ", ", "\n", "\r\n\r\n", "- item ", "é_1 ", "x" * 50, "!?", "  "]), max_size=1500), st.sampled_from(["paragraph", "list", "code", "table"]))
def test_split_bounds(parts, kind):
    pieces_hold("".join(parts), kind)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet="ab_1é日 \n\r.,;!\"'”)-#|\u00a0\u3000\U0001f600", max_size=40), max_size=6))
def test_units_against_plain_reading(texts):
    """Token counts of a batch and the units of a text, against a regular expression."""
    import re

    assert splitting.count_all(texts).tolist() == [splitting.count_tokens(t) for t in texts]
    for text in texts:
        starts, ends, strength = splitting.units(text)
        want = [(at, min(at + splitting.UNIT_CHARS, m.end())) for m in re.finditer(r"\w+|[^\w\s]", text) for at in range(m.start(), m.end(), splitting.UNIT_CHARS)]
        assert list(zip(starts.tolist(), ends.tolist())) == want
        for (_, a), (b, _), force in zip(want, want[1:], strength.tolist()[1:]):
            lines = len(re.findall(r"\r\n|\r|\n", text[a:b]))
            assert (force == splitting.PARAGRAPH) == (lines > 1) and (force in (splitting.LINE, splitting.ITEM)) == (lines == 1) and (force <= splitting.GLUED) == (a == b)


def test_split_prefers_natural_cuts():
    paragraph = "One two three four five six seven eight nine ten. " * 12
    pieces = pieces_hold("\n\n".join([paragraph] * 6), "paragraph")
    assert all(p[3].rstrip().endswith(".") for p in pieces)
    pieces_hold("x" * 100_000, "paragraph")
    code = "```py\n" + "\n".join(f"x{k} = {k}" for k in range(400)) + "\n```"
    assert all(p[3].startswith("```py") and p[3].rstrip().endswith("```") for p in pieces_hold(code, "code"))
    table = "| a | b |\n| --- | --- |\n" + "\n".join(f"| {k} | v |" for k in range(300))
    assert all("| --- | --- |" in p[3] for p in pieces_hold(table, "table"))


def test_strongest_boundary():
    dice = random.Random(2)
    import numpy as np

    strength = np.array([dice.randrange(8) for _ in range(300)])
    index = splitting.Boundaries(strength, 200)
    for _ in range(500):
        low = dice.randrange(280)
        high = dice.randrange(low, min(low + 199, 299) + 1)
        top = strength[low : high + 1].max()
        places = [k for k in range(low, high + 1) if strength[k] == top]
        assert index.strongest(low, high) == (places[-1], top)
        assert index.strongest(low, high, rightmost=False) == (places[0], top)


def test_split_blocks(spark):
    rows = [(1, "paragraph", "a b", ["H"], 1), (2, None, "word " * 700, None, 1), (3, "code", None, [], 1), (4, "list", "", [], 1), (2, None, "word " * 700, None, 1)]
    df = spark.createDataFrame(rows, "block_id long, block_kind string, block_text string, heading_trail array<string>, piece_no int")
    got = splitting.split_blocks(df).collect()
    assert [(r["n_pieces"], r["heading_trail"], r["piece_text"]) for r in got if r["block_id"] == 1] == [(1, ["H"], "a b")]
    assert len([r for r in got if r["block_id"] == 2]) == 2 * [r["n_pieces"] for r in got if r["block_id"] == 2][0]
    assert {r["block_id"] for r in got} == {1, 2}


WORDS = {"botany": "petal stamen pollen sepal root leaf moss fern".split(), "sailing": "mast keel rudder jib anchor hull tiller sail".split()}


def corpus():
    dice = random.Random(4)
    stock = ["More on this tomorrow.", "The list is not complete yet.", "Please keep it short."]

    def sentence(subject):
        a, b = dice.sample(WORDS[subject], 2)
        return dice.choice([f"We talked about the {a} and the {b}.", f"Open point: does the {a} need the {b}?", f"The {a} is easy to confuse with the {b}."])

    docs, truth = [], {}
    for k in range(400):
        parts = {0: [("botany", 8)], 1: [("sailing", 8)], 2: [("botany", 5), ("sailing", 4)], 3: [("botany", 9), ("sailing", 1)]}[k % 4]
        lines = [sentence(s) for s, n in parts for _ in range(n)] + [dice.choice(stock) for _ in range(3)]
        docs.append((k, " ".join(lines)))
        truth[k] = {s for s, n in parts if n > 1}
    docs += [(900, " ".join(stock)), (901, ""), (902, None)]
    labels = [(k, (" Botany" if "botany" in truth[k] else "SAILING "), None) for k in range(0, 400, 5)] + [(0, "nonsense", None), (None, "botany", None)]
    return docs, labels, truth


def test_subjects(spark, tmp_path):
    docs, labels, truth = corpus()
    d = spark.createDataFrame(docs, "doc_id long, text string")
    lab = spark.createDataFrame(labels, "doc_id long, subject string, labelled_by string")
    sub = spark.createDataFrame([("botany",), ("sailing",)], "subject string")
    got = defaultdict(set)
    for r in assign_subjects(d, lab, sub).collect():
        got[r["doc_id"]].add(r["subject"])
    right = sum(got.get(k, set()) == truth[k] for k in truth)
    assert right / len(truth) > 0.95
    assert not set(got) & {900, 901, 902}
    model, coded = fit(d, lab, sub)
    terms = topic_terms(d, model).filter("subject = 'botany'").collect()
    assert terms and all(r["language"] == "en" and r["term"] in WORDS["botany"] for r in terms if r["place"] <= 3)
    model.save(spark, f"file://{tmp_path}/model")
    again = composition(proportions(coded, Model.load(spark, f"file://{tmp_path}/model")))
    shares = {r["subject"]: r["corpus_share"] for r in again.collect()}
    assert abs(sum(shares.values()) - 1) < 1e-9 and set(shares) == {"botany", "sailing"}
    assert assign_subjects(d.limit(0), lab, sub).count() == 0
    assert assign_subjects(d, lab.limit(0), sub).count() == 0
    assert assign_subjects(d, lab, sub.limit(0)).count() == 0


def test_single_short_sentences(spark):
    """A document of one sentence, or a list item, with one known term treats its subject; a stock phrase none."""
    docs, labels, _ = corpus()
    docs += [(1000, "Notes on the stamen."), (1001, "- rudder"), (1002, "More on this tomorrow.")]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    lab = spark.createDataFrame(labels, "doc_id long, subject string, labelled_by string")
    sub = spark.createDataFrame([("botany",), ("sailing",)] + [(f"other {k}",) for k in range(8)], "subject string")
    got = {(r["doc_id"], r["subject"]) for r in assign_subjects(d, lab, sub).filter("doc_id >= 1000").collect()}
    assert got == {(1000, "botany"), (1001, "sailing")}


def test_topics_and_their_map_rest_on_all_documents(spark):
    """A subject, its words and its labels count wherever they stand: here in the 800 documents with the greatest hash of
    their id, behind 20,000 others, all labelled. Every term of every document is in the model."""
    order = [r["id"] for r in spark.range(20_800).orderBy(F.xxhash64("id"), "id").collect()]
    dice, texts = random.Random(6), {}
    for k, doc in enumerate(order):
        a, b, c, e = dice.sample(WORDS["botany" if k < 20_000 else "sailing"], 4)
        texts[doc] = f"We talked about the {a} and the {b}. The {c} is easy to confuse with the {e}."
    d = spark.createDataFrame(sorted(texts.items()), "doc_id long, text string").repartition(4)
    lab = spark.createDataFrame([(doc, "botany" if k < 20_000 else "sailing") for k, doc in enumerate(order)], "doc_id long, subject string")
    sub = spark.createDataFrame([("botany",), ("sailing",)], "subject string")
    model, coded = fit(d, lab, sub)
    terms = coded.agg(F.sum(F.octet_length("terms") / 2)).first()[0]
    assert abs(sum(t.counts.sum() for t in model.topics.values()) / terms - 1) < 1e-3
    got = {(r["doc_id"], r["subject"]) for r in proportions(coded, model).filter("share > 0.5").collect()}
    true = {(doc, "botany" if k < 20_000 else "sailing") for k, doc in enumerate(order)}
    assert len(got & true) / len(true) > 0.99 and len(got - true) / len(got) < 0.01
    assert sum((doc, "sailing") in got for doc in order[20_000:]) > 790


def test_topics_are_read_by_their_top_terms():
    """Labels name topics and don't make them: the same topics stand for other subjects under other labels."""
    import numpy as np

    from tarnwork.llm.subjects import Topics, mapped

    topics = Topics(np.array([3, 5, 9]), np.array([[1.0, 9, 0, 0], [1, 0, 9, 0], [9, 1, 1, 3]]))
    labelled = np.array([[4.0, 0], [0, 4], [2, 2]])
    assert mapped(topics, Topics(np.array([3, 5, 9]), labelled)).tolist() == [-1, 0, 1, -1]
    assert mapped(topics, Topics(np.array([3, 5, 9]), labelled[:, ::-1])).tolist() == [-1, 1, 0, -1]
    assert mapped(topics, Topics(np.array([70]), np.array([[1.0, 0]]))).tolist() == [-1, -1, -1, -1]
    assert mapped(topics, Topics(np.zeros(0, np.int64), np.zeros((0, 2)))).tolist() == [-1, -1, -1, -1]


def test_inference_is_variational_bayes():
    """The matrix form against the plain update of every word of every document."""
    import math

    import numpy as np

    from tarnwork.llm import subjects

    dice = np.random.default_rng(5)
    weights = dice.random((subjects.BUCKETS, 4), np.float32)
    doc = np.sort(dice.integers(0, 6, 80))
    bucket = dice.integers(0, 30, 80)
    sums = np.zeros((subjects.BUCKETS, 4), np.float32)
    got = subjects.infer(doc, bucket, 6, weights, rounds=3, sums=sums)
    digamma = lambda x: (math.lgamma(x + 1e-5) - math.lgamma(x - 1e-5)) / 2e-5
    alpha, counted = [subjects.GENERAL] + [subjects.ALPHA] * 3, np.zeros((subjects.BUCKETS, 4))
    for d in range(6):
        words = bucket[doc == d]
        gamma = [a + len(words) / 4 for a in alpha]
        for turn in range(4):
            shares = [[math.exp(digamma(gamma[k])) * float(weights[w, k]) for k in range(4)] for w in words]
            shares = [[x / sum(r) for x in r] for r in shares]
            if turn < 3:
                gamma = [alpha[k] + sum(r[k] for r in shares) for k in range(4)]
        np.add.at(counted, words, shares)
        assert np.allclose(got[d], gamma, rtol=1e-3)
    assert np.allclose(sums, counted, atol=1e-2)


def test_sentences():
    text = "# Head\n\nOne here. Two there?\n- item one\n| a | b |\n| --- | --- |\n```py\ncode here.\n```\n<b>Bold</b> one.\n---\n```\nunclosed stays."
    assert sentences(text) == ["One here.", "Two there?", "item one", "| a | b |", "Bold  one.", "unclosed stays."]
    assert sentences("") == []


def test_terms():
    """Words as a plain reading of them, by document, sentence and language; a text beyond a chunk reads the same."""
    t = terms_of(["Der Hund ist hier. Ok.", "", "The dog\u00ad and the DOG, naïve l'eau"])
    assert t.doc.tolist() == [0, 0, 2] and t.language.tolist() == [1, 1, 0]
    assert t.sentence.tolist() == [0, 0, 1, 2, 2, 2, 2] and t.bucket.tolist() == bucket_of(["hund", "hier", "ok", "dog", "dog", "naïve", "eau"]).tolist()
    assert terms_of([]).bucket.tolist() == [] and terms_of(["", "---"]).doc.tolist() == []
    long = "A word here. " * 400_000
    t = terms_of([long])
    assert len(t.doc) == 400_000 and len(t.bucket) == 800_000 and len(set(t.bucket.tolist())) == 2
