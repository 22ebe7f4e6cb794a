"""The personal-information finder: literal cases, held-out generated texts, fields and edges."""

import json

import pytest

from tarnwork.llm.pii import PLACEHOLDERS, find_personal, mask_personal, mask_text
from tarnwork.llm.pii_lexer import candidates
from tarnwork.llm.pii_training import sample, trained

CASES = [
    ("Ask Clara Testdorf about it.", {("person_name", "Clara Testdorf")}),
    ("Dr. J. van der Halmfeld signed it.", {("person_name", "J. van der Halmfeld")}),
    ("Merci à MIRA O'SELBY pour tout.", {("person_name", "MIRA O'SELBY")}),
    ("Owen is the name of the new runner; Silver Gate is a code name, not Amber Ledger.", set()),
    ("mail (ann.lee+x@mail.halm.example) twice", {("email", "ann.lee+x@mail.halm.example")}),
    ("write to ann [at] halm.example now", {("email", "ann [at] halm.example")}),
    ("git@forge.example:halm/halm.git and tool-pack@2.14.3 again", set()),
    ("Call +44 7700 900123 ext. 12 please", {("phone", "+44 7700 900123 ext. 12")}),
    ("ids 10445-84-4471 onwards, build 3.0.480, from 2026-04-02 to 2026-05-02", set()),
    ("SSN 980-02-3746 was pasted", {("id_number", "980-02-3746")}),
    ("Ticket DK17656176 and run C5617656176 say the same.", set()),
    ("Ship it to 12 Halm Street, Apt 4, Selby, OH 00123.", {("street_address", "12 Halm Street, Apt 4, Selby, OH 00123")}),
    ("Anschrift: Halmstraße 4a\n00123 Selbach", {("street_address", "Halmstraße 4a\n00123 Selbach")}),
]


@pytest.fixture(scope="module")
def model():
    return trained()


@pytest.mark.parametrize("text,want", CASES)
def test_cases(model, text, want):
    (found,) = model.find([text])
    assert {(kind, text[c.start : c.end]) for c, kind in found} == want


def test_held_out(model):
    texts, spans = sample(400, seed=1234)
    got = model.find(texts)
    found = [{(c.start, c.end, k) for c, k in row} for row in got]
    true = [set(s) for s in spans]
    hit = sum(len(a & b) for a, b in zip(found, true))
    assert hit / sum(map(len, found)) > 0.97 and hit / sum(map(len, true)) > 0.92


def test_skip_edges_carry_evidence(model):
    """A bare repeated name takes its label from a clear mention far away."""
    clear = "Signed-off-by: Zelkan Orvath <zelkan.orvath@halm.example>"
    text = clear + "\n" + "plain words " * 50 + "\nZelkan Orvath"
    (found,) = model.find([text])
    assert sum(k == "person_name" for _, k in found) == 2


def test_masking_keeps_the_rest(model):
    text = "  Ask Clara Testdorf,\n\tor mail a.b@halm.example!  "
    assert mask_text(text, model) == f"  Ask {PLACEHOLDERS['person_name']},\n\tor mail {PLACEHOLDERS['email']}!  "
    assert mask_text("", model) == ""


def test_fields(spark, model):
    mail = "x@halm.example"
    message = lambda content: json.dumps({"role": "user", "content": content})
    rows = [
        (1, message(f"to {mail} and {mail}"), None),
        (2, message([{"type": "image", "text": mail}, {"type": "text", "text": f"cc {mail}"}, mail, {"type": "text", "text": 5}]), None),
        (3, json.dumps(message(f"é {mail}")), json.dumps({"stdout": f"rcpt={mail} ok", "stderr": mail})),
        (4, message(mail)[:-1], "not json"),
        (5, None, None),
        (6, "", json.dumps(json.dumps({"stdout": mail}))),
        (7, message("x" * 300_000 + f" {mail}"), None),
        (1, message(f"to {mail} and {mail}"), None),
    ]
    df = spark.createDataFrame(rows, "line_id long, message string, tool_use_result string")
    got = sorted((r["line_id"], r["field_path"], r["found_text"]) for r in find_personal(df, field=model).collect())
    assert got == sorted([(1, "message.content", mail), (1, "message.content", mail), (2, "message.content[1].text", mail), (3, "message.content", mail), (3, "tool_use_result.stdout", mail), (7, "message.content", mail)])
    masked = {(r["line_id"], r["field_path"]): r["masked_text"] for r in mask_personal(df, field=model).collect()}
    assert masked[3, "tool_use_result.stdout"] == "rcpt=[EMAIL] ok" and len(masked) == 5
    assert find_personal(df.limit(0), field=model).count() == 0


@pytest.mark.parametrize("text,name", [
    ("Pair with lúcia dunmarrow on the migration", "lúcia dunmarrow"),
    ("Ask dunmarrow, lúcia about it", "dunmarrow, lúcia"),
    ("ask peter li about it", "peter li"),
    ("owner: l. dunmarrow\n", "l. dunmarrow"),
    ("According to jürgen q. ek, it is fine.", "jürgen q. ek"),
    ("* tavo brellmann has 4 notes", "tavo brellmann"),
])
def test_lower_case_names(model, text, name):
    """Accents, inverse order, initials, short families and given names outside the list."""
    (found,) = model.find([text])
    assert [(kind, text[c.start : c.end]) for c, kind in found] == [("person_name", name)]


@pytest.mark.parametrize("text", ["the loader is fine and the build took nine seconds today", "Das ist deutlich schneller geworden", "e. g. parser code"])
def test_lower_case_prose_names_nobody(model, text):
    (found,) = model.find([text])
    assert found == []


# Given and family names that neither the word lists nor the training sentences hold, and frames unlike theirs.
UNSEEN_GIVEN = "Tamsin Ewald Renske Bartosz Ximena Odalys Perrin Gundula Lucjan Ottilie Radomir Siobhan Quentin Yevgenia Zdenka Aurelio Branwen Cosima Dagny Eustace".split()
UNSEEN_FAMILY = "Kowalczyk Abernathy Thibodeaux Vasquez Nakagawa Okonkwo Lindqvist Petrossian Haverkamp Echeverria Dubrovsky Castellanos Fitzwilliam Grzybowski Huisman Jankauskas Lefebvre Mukherjee Novotny Papadakis".split()
FRAMES = ["The minutes were taken by {} yesterday.", "{} will present the results in May.", "Reviewer: {}", "We forwarded it to {}, who agreed.", "Danke an {} für die Hilfe.", "Le rapport de {} est arrivé.", "La nota de {} llegó ayer.", "assigned_to: {}", "Both {} and the team signed off.", "(see the comment of {})"]


def test_unseen_names_in_unseen_frames(model):
    """Recall and precision on names outside every list, capitalised and in several forms."""
    import random

    dice = random.Random(11)
    texts, true = [], []
    for k in range(400):
        g, f = dice.choice(UNSEEN_GIVEN), dice.choice(UNSEEN_FAMILY)
        name = [f"{g} {f}", f"{g} {f}", f"{g} {f}", f"{g[0]}. {f}", f"{g} van der {f}", f"{g} Q. {f}"][k % 6]
        frame = dice.choice(FRAMES)
        texts.append(frame.format(name))
        true.append({name})
    got = model.find(texts)
    found = [{t[c.start : c.end] for c, _ in row} for t, row in zip(texts, got)]
    hit = sum(len(a & b) for a, b in zip(found, true))
    assert hit / len(texts) >= 0.9 and hit / sum(map(len, found)) >= 0.9


def test_cost_is_linear(model):
    """A text of a megabyte with tens of thousands of candidates, and runs that invite repeated search."""
    import time

    part = "Ask Clara Testdorf, mail a.b@halm.example or call 030 1234567 12 now; SSN 980-02-3746.\n"
    costs = []
    for n in (1500, 6000):
        begun = time.process_time()
        (found,) = model.find([part * n])
        costs.append(time.process_time() - begun)
        assert len(found) == 4 * n
    assert costs[1] < 8 * costs[0]
    for text in ("7" * 100_000 + "a", "Abc " * 50_000, "a.b" * 50_000, "1 " * 50_000 + "x", "Aa-" * 50_000, "\n" * 100_000, "de la " * 30_000 + "X"):
        begun = time.process_time()
        candidates(text)
        assert time.process_time() - begun < 20, text[:10]
