"""A skip-chain conditional random field over the candidates of a document.

Nodes are the candidates of `pii_lexer`, in order; labels are `O` and the five kinds, restricted to what a
candidate's grammar admits. Neighbours form a linear chain; repeated or similar candidates (same text, a
shared word of a name, a mail address made of a name's words) are joined by skip edges, however far apart
they lie in the document. Marginals come from loopy belief propagation, run for all documents of a batch at
once. Weights are fitted by pseudo-likelihood on generated sentences (`pii_training`), never on the input.
"""

from __future__ import annotations

import re
from collections import defaultdict
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np

from tarnwork.llm import pii_lexicon as L
from tarnwork.llm.pii_lexer import ADDRESS, EMAIL, NAME, NUMBER, Candidate, candidates, fold, is_given, is_object

LABELS = ["O", "email", "phone", "id_number", "street_address", "person_name"]
ADMITS = np.zeros((4, 6), bool)
ADMITS[:, 0] = True
ADMITS[EMAIL, 1] = ADMITS[NUMBER, 2] = ADMITS[NUMBER, 3] = ADMITS[ADDRESS, 4] = ADMITS[NAME, 5] = True
CHAIN, SAME, WORD, MAIL = range(4)
ROUNDS = 6

_ID_BEFORE = re.compile("|".join(L.ID_LABELS), re.I)
_PHONE_BEFORE = re.compile("|".join(L.PHONE_LABELS), re.I)
_WORDS = re.compile(r"[^\W_]+")
_FIRST_WORD = re.compile(r"^[^\w\n]*([^\W\d_]+)")
_GROUPS = re.compile(r"\d+")


def last_word(before: str) -> str:
    """The letters that end a text, whatever signs follow them on the line or one line feed at the end."""
    end = len(before) - before.endswith("\n")
    while end and not (before[end - 1].isalnum() or before[end - 1] in "_\n"):
        end -= 1
    begin = end
    while begin and before[begin - 1].isalpha():
        begin -= 1
    return before[begin:end]


@dataclass(frozen=True)
class Known:
    """What features of a text's candidates look up: whether it labels a number of a person, and ordinary words."""

    labelled: bool
    words_key: int


def _number(text: str, c: Candidate, out: list[str], known: Known) -> None:
    raw = text[c.start : c.end]
    before, after = text[max(0, c.start - 40) : c.start], text[c.end : c.end + 40]
    line = before.rpartition("\n")[2]
    groups = _GROUPS.findall(raw)
    digits = sum(map(len, groups))
    letters = sum(ch.isalpha() for ch in raw)
    shape = "-".join(str(len(g)) for g in groups)
    intl = raw.startswith("+") or raw.startswith("00")
    out += [f"n:shape={shape}", f"n:digits={digits}", f"n:groups={len(groups)}", f"n:letters={min(letters, 3)}"]
    if intl:
        out.append("n:intl")
    if "(" in raw:
        out.append("n:paren")
    if raw[0] == "0" and not letters:
        out.append("n:zero")
    if re.search(r"[a-z]", raw):
        out.append("n:ext")
    if letters:
        out.append("n:alnum=" + re.sub(r"\d+", "9", re.sub(r"[A-Z]", "A", raw)))
    marks = [m for m in _ID_BEFORE.finditer(line)]
    near = bool(marks) and not re.search(r"\d{4}|[.!?;] ", line[marks[-1].end() :].lstrip(".:"))
    tail = _ID_BEFORE.search(after[:36])
    close = tail and not re.search(r"\d|[.!?;] |\n", after[: tail.start()])
    if near or close:
        out.append("n:idlabel")
        out.append(f"n:idlabel,letters={bool(letters)}")
    elif known.labelled:
        out.append("n:idlabel_doc")
        out.append(f"n:idlabel_doc,shape={shape}")
    else:
        out.append("n:noidlabel")
    if _PHONE_BEFORE.search(line[-24:]):
        out.append("n:phonelabel")
    if word := last_word(line):
        out.append("n:prev=" + fold(word))
    if m := _FIRST_WORD.search(after):
        out.append("n:next=" + fold(m[1]))


def _email(text: str, c: Candidate, out: list[str], known: Known) -> None:
    raw = text[c.start : c.end]
    after = text[c.end : c.end + 2]
    domain = re.split(r"@|＠|%40|&#64;|[\])}>]| (?:at|AT|arroba|arobase) ", raw, maxsplit=1)[-1]
    top = re.split(r"[.\s\])}]+", domain.strip())[-1]
    out.append("e:top=" + ("digits" if top.isdigit() or not top[:1].isalpha() else "alpha" if top.isalpha() and len(top) > 1 else "odd"))
    out.append(f"e:dotted={bool(re.search(r'[.]|dot|punkt|point|punto', domain, re.I))}")
    if after[:1] == ":" and after[1:2] not in ("", " ", "\n"):
        out.append("e:remote")
    if after[:1] == "/":
        out.append("e:path")
    if re.match(r"git@", raw):
        out.append("e:git")
    if "@" not in raw:
        out.append("e:spelled")


def _address(text: str, c: Candidate, out: list[str], known: Known) -> None:
    raw = text[c.start : c.end]
    out.append(f"a:post={bool(re.search(r'[0-9]{4,5}', raw[4:]))}")
    out.append(f"a:tail={raw.count(',') + raw.count(chr(10)) > 0}")
    if word := last_word(text[max(0, c.start - 30) : c.start]):
        out.append("a:prev=" + fold(word))
    if m := _FIRST_WORD.search(text[c.end : c.end + 25]):
        out.append("a:next=" + fold(m[1]))


# Sets of ordinary words by their hash: a worker gets an equal set with every task, and comparing sets is dear.
_COMMON: dict[int, frozenset[str]] = {}


@lru_cache(maxsize=1 << 16)
def _name_itself(raw: str, words_key: int) -> tuple[str, ...]:
    """Features of a name-like span by itself."""
    common = _COMMON[words_key]
    out: list[str] = []
    words = raw.replace(",", " ").split()
    first, last = words[0], words[-1]
    if "," in raw:
        out.append("p:inverse")
        family = raw.split(",")[0].split()[-1]
        given = raw.split(",")[1].split()[0]
    else:
        family, given = last, first
    g, f = fold(given.strip(".")), fold(family)
    initial = len(given.strip(".")) == 1
    kind_g = "initial" if initial else "given" if is_given(given) else "code" if g in L.CODE else "other"
    both = kind_g == "given" and g in L.CODE
    kind_f = "surnoun" if f in L.SURNAME_NOUNS else "noun" if f in L.CODE or f.rstrip("s") in L.CODE else "starter" if f in L.STARTERS else "given" if is_given(family) else "other"
    out += [f"p:given={kind_g}{'+code' if both else ''}", f"p:family={kind_f}", f"p:both={kind_g},{kind_f}", f"p:words={min(len(words), 4)}"]
    if _ID_BEFORE.search(raw) or _PHONE_BEFORE.search(raw):
        out.append("p:label")
    plain = "".join(str(int(w.lower() in common)) for w in (given, family))
    out += [f"p:common={plain}", f"p:common={plain},{kind_g},{kind_f}", f"p:common={plain},lower={raw.islower()}"]
    if is_object(raw):
        out += ["p:object", f"p:object,{kind_g}", f"p:object,lower={raw.islower()}"]
    if raw.isupper():
        out.append("p:upper")
    if raw.islower():
        out.append(f"p:lower={kind_g},{kind_f}")
    if family.isupper() != given.isupper() and not initial:
        out.append("p:mixed")
    if any(w.islower() for w in words[1:-1]):
        out.append("p:particle")
    if not (family[:1].isupper() or raw.islower()) or any(ch.isdigit() for ch in raw):
        out.append("p:odd")
    return tuple(out)


def _name(text: str, c: Candidate, out: list[str], known: Known) -> None:
    out += _name_itself(text[c.start : c.end], known.words_key)
    before, after = text[max(0, c.start - 30) : c.start], text[c.end : c.end + 20]
    out.append("p:before=" + (before[-1:] if not before[-1:].isalnum() else "x") + "|" + before[-2:-1])
    out.append("p:after=" + (after[:2] if not after[:1].isalnum() else "x"))
    if word := last_word(before):
        w = fold(word)
        out.append("p:title" if w in L.TITLES else "p:prev=" + w)
    else:
        out.append("p:prev=^")
    if m := _FIRST_WORD.search(after):
        out.append("p:next=" + fold(m[1]))


_FEATURES = {NUMBER: _number, EMAIL: _email, ADDRESS: _address, NAME: _name}


@dataclass
class Graph:
    """Nodes and edges of a batch of documents."""

    feature: list[int] = field(default_factory=list)
    owner: list[int] = field(default_factory=list)
    sort: list[int] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    kind: list[int] = field(default_factory=list)
    common: frozenset[str] = frozenset()

    def add(self, text: str, found: list[Candidate], known: dict[str, int], grow: bool = False) -> None:
        base = len(self.sort)
        about = Known(any(c.sort == NUMBER for c in found) and _ID_BEFORE.search(text) is not None, hash(self.common))
        _COMMON.setdefault(about.words_key, self.common)
        same: dict[str, int] = {}
        word: dict[str, int] = {}
        for k, c in enumerate(found):
            node = base + k
            names = [f"b:{c.sort}"]
            _FEATURES[c.sort](text, c, names, about)
            for name in names:
                at = known.setdefault(name, len(known)) if grow else known.get(name)
                if at is not None:
                    self.feature.append(at)
                    self.owner.append(node)
            self.sort.append(c.sort)
            if k:
                self._edge(node - 1, node, CHAIN)
            raw = fold(text[c.start : c.end]) if c.sort in (NAME, EMAIL) else text[c.start : c.end]
            if raw in same:
                self._edge(same[raw], node, SAME)
            same[raw] = node
            if c.sort in (NAME, EMAIL):
                parts = _WORDS.findall(raw if c.sort == NAME else re.split(r"@|\s?[\[({]| at ", raw)[0])
                for part in dict.fromkeys(parts):
                    if len(part) >= 4:
                        if part in word and word[part] != node - 1:
                            self._edge(word[part], node, WORD if self.sort[word[part]] == c.sort else MAIL)
                        word[part] = node

    def _edge(self, a: int, b: int, kind: int) -> None:
        self.left.append(a)
        self.right.append(b)
        self.kind.append(kind)


@dataclass
class Field:
    """Weights: `node[feature, label]` and `edge[kind, label, label]`."""

    known: dict[str, int]
    node: np.ndarray
    edge: np.ndarray
    common: frozenset[str] = frozenset()

    def potentials(self, graph: Graph) -> np.ndarray:
        n = len(graph.sort)
        out = np.zeros((n, 6))
        if graph.feature:
            np.add.at(out, np.asarray(graph.owner), self.node[np.asarray(graph.feature)])
        out[~ADMITS[np.asarray(graph.sort, int)]] = -1e9
        return out

    def marginals(self, graph: Graph) -> np.ndarray:
        """Label probabilities of every node after `ROUNDS` of damped loopy sum-product messages."""
        unary = self.potentials(graph)
        if graph.left:
            a, b, kind = np.asarray(graph.left), np.asarray(graph.right), np.asarray(graph.kind)
            source, target = np.r_[a, b], np.r_[b, a]
            pair = np.concatenate([self.edge[kind], self.edge[kind].transpose(0, 2, 1)])
            back = np.r_[np.arange(len(a)) + len(a), np.arange(len(a))]
            message = np.zeros((len(source), 6))
            for _ in range(ROUNDS):
                belief = unary.copy()
                np.add.at(belief, target, message)
                send = belief[source] - message[back]
                new = _lse(send[:, :, None] + pair, 1)
                message = 0.5 * message + 0.5 * (new - _lse(new, 1)[:, None])
            np.add.at(unary, target, message)
        unary -= unary.max(1, keepdims=True)
        p = np.exp(unary)
        return p / p.sum(1, keepdims=True)

    def find(self, texts: list[str]) -> list[list[tuple[Candidate, str]]]:
        """Personal items of each text."""
        return self.decide(texts, [candidates(t, self.common) for t in texts])

    def decide(self, texts: list[str], found: list[list[Candidate]]) -> list[list[tuple[Candidate, str]]]:
        """Personal items of each text, from one propagation over all."""
        graph = Graph(common=self.common)
        for text, cs in zip(texts, found):
            graph.add(text, cs, self.known)
        out: list[list[tuple[Candidate, str]]] = []
        best = self.marginals(graph).argmax(1).tolist() if graph.sort else []
        at = 0
        for cs in found:
            out.append([(c, LABELS[y]) for c, y in zip(cs, best[at : at + len(cs)]) if y])
            at += len(cs)
        return out


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis)) + top.squeeze(axis)


def fit(texts: list[str], found: list[list[Candidate]], gold: list[list[int]], *, common: frozenset[str] = frozenset(), passes: int = 150, rate: float = 0.3, decay: float = 2e-4) -> Field:
    """Weights that maximise the pseudo-likelihood of gold labels (each node given its neighbours' labels)."""
    known: dict[str, int] = {}
    graph = Graph(common=common)
    for text, cs in zip(texts, found):
        graph.add(text, cs, known, grow=True)
    y = np.array([v for row in gold for v in row])
    feature, owner = np.asarray(graph.feature), np.asarray(graph.owner)
    # Words beside a name are left out half the time, so that no decision rests on words seen in training alone.
    beside = np.array([name.startswith(("p:prev=", "p:next=")) for name in known])
    kept = ~beside[feature] | (np.random.default_rng(3).random(len(feature)) < 0.5)
    feature, owner = feature[kept], owner[kept]
    a, b, kind = np.asarray(graph.left, int), np.asarray(graph.right, int), np.asarray(graph.kind, int)
    mask = ADMITS[np.asarray(graph.sort)]
    model = Field(known, np.zeros((len(known), 6)), np.zeros((4, 6, 6)), common)
    sums = [np.full_like(model.node, 1e-6), np.full_like(model.edge, 1e-6)]
    n = len(y)
    one = np.eye(6)[y]
    for _ in range(passes):
        score = np.zeros((n, 6))
        np.add.at(score, owner, model.node[feature])
        np.add.at(score, b, model.edge[kind, y[a]])
        np.add.at(score, a, model.edge[kind, :, y[b]])
        score[~mask] = -1e9
        score -= score.max(1, keepdims=True)
        p = np.exp(score)
        p /= p.sum(1, keepdims=True)
        wrong = p - one
        g_node = np.zeros_like(model.node)
        np.add.at(g_node, feature, wrong[owner])
        g_edge = np.zeros_like(model.edge)
        np.add.at(g_edge, (kind, y[a]), wrong[b])
        flipped = np.zeros_like(model.edge)
        np.add.at(flipped, (kind, y[b]), wrong[a])
        g_edge += flipped.transpose(0, 2, 1)
        for w, g, s in ((model.node, g_node / n, sums[0]), (model.edge, g_edge / n, sums[1])):
            g += decay * w / n * 10
            s += g * g
            w -= rate * g / np.sqrt(s)
    return model
