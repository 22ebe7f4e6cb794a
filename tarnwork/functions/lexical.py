"""Full-text primitives: tokens by position, an English stemmer, web-search queries and cover density.

A text's lexemes are an array by position, null where a stop word stood, so that phrases are told by index and
containment by `array_contains`. Configuration `simple` keeps every word and stays in the JVM; `english` drops
stop words and stems, in an Arrow function.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
import math
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnwork.runtime import ship_active

WORD = r"[\p{L}\p{N}_]+"
_WORD = re.compile(r"\w+")

# English stop words.
STOP = frozenset(
    """
    i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they
    them their theirs themselves what which who whom this that these those am is are was were be been being have has had having do
    does did doing a an the and but if or because as until while of at by for with about against between into through during before
    after above below to from up down in out on off over under again further then once here there when where why how all any both each
    few more most other some such no nor not only own same so than too very s t can will just don should now
    """.split()
)

# The exceptional forms of the published stemmer description.
_SPECIAL = {"skis": "ski", "skies": "sky", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl", "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes"}
_KEPT = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
_STEP2 = {"ization": "ize", "ational": "ate", "fulness": "ful", "ousness": "ous", "iveness": "ive", "tional": "tion", "biliti": "ble", "lessli": "less", "entli": "ent", "ation": "ate", "alism": "al", "aliti": "al", "ousli": "ous", "iviti": "ive", "fulli": "ful", "enci": "ence", "anci": "ance", "abli": "able", "izer": "ize", "ator": "ate", "alli": "al", "bli": "ble"}
_STEP3 = {"ational": "ate", "tional": "tion", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ness": "", "ful": ""}
_STEP4 = ["ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "al", "er", "ic"]
_VOWEL = "aeiouy"


@lru_cache(maxsize=1 << 16)
def stem(word: str) -> str:
    """English stem by the second version of the published suffix-stripping algorithm."""
    if len(word) <= 2:
        return word
    if word in _SPECIAL:
        return _SPECIAL[word]
    w = word.lstrip("'")
    w = re.sub(r"(^|[aeiouy])y", r"\1Y", w)
    r1 = len(w)
    if m := re.match(r"gener|commun|arsen", w):
        r1 = m.end()
    elif m := re.search(r"[aeiouy][^aeiouy]", w):
        r1 = m.end()
    m = re.compile(r"[aeiouy][^aeiouy]").search(w, r1)
    r2 = m.end() if m else len(w)
    vowel = lambda s: any(c in _VOWEL for c in s)

    def short_end(s: str) -> bool:
        return bool(re.search(r"(?:^|[^aeiouy])[aeiouy][^aeiouywxY]$|^[aeiouy][^aeiouy]$", s))

    w = re.sub(r"'s'$|'s$|'$", "", w)
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and vowel(w[:-2]):
        w = w[:-1]
    if w in _KEPT:
        return w
    if w.endswith(("eedly", "eed")):
        cut = 5 if w.endswith("eedly") else 3
        if len(w) - cut >= r1:
            w = w[:-cut] + "ee"
    else:
        for end in ("ingly", "edly", "ing", "ed"):
            if w.endswith(end):
                if vowel(w[: -len(end)]):
                    w = w[: -len(end)]
                    if w.endswith(("at", "bl", "iz")):
                        w += "e"
                    elif re.search(r"(bb|dd|ff|gg|mm|nn|pp|rr|tt)$", w):
                        w = w[:-1]
                    elif len(w) <= r1 and short_end(w):
                        w += "e"
                break
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in _VOWEL:
        w = w[:-1] + "i"
    for end in sorted([*_STEP2, "ogi", "li"], key=len, reverse=True):
        if w.endswith(end):
            if len(w) - len(end) >= r1:
                if end == "ogi":
                    w = w[:-1] if w.endswith("logi") else w
                elif end == "li":
                    w = w[:-2] if w[-3:-2] in set("cdeghkmnrt") else w
                else:
                    w = w[: -len(end)] + _STEP2[end]
            break
    for end in sorted([*_STEP3, "ative"], key=len, reverse=True):
        if w.endswith(end):
            if len(w) - len(end) >= r1:
                if end == "ative":
                    w = w[:-5] if len(w) - 5 >= r2 else w
                else:
                    w = w[: -len(end)] + _STEP3[end]
            break
    for end in sorted([*_STEP4, "ion"], key=len, reverse=True):
        if w.endswith(end):
            if len(w) - len(end) >= r2 and (end != "ion" or w[-4:-3] in ("s", "t")):
                w = w[: -len(end)]
            break
    if w.endswith("e") and (len(w) - 1 >= r2 or len(w) - 1 >= r1 and not short_end(w[:-1])):
        w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.replace("Y", "y")


def lexemes_of(text: str, config: str = "english") -> list[str | None]:
    """Lexemes by position, None for stop words."""
    words = [w.lower() for w in _WORD.findall(text or "")]
    return words if config == "simple" else [None if w in STOP else stem(w) for w in words]


@F.pandas_udf(T.ArrayType(T.StringType()))
def _english(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for series in texts:
        yield series.map(lambda t: lexemes_of(t) if t is not None else None)


def lexemes(text: Column, config: str = "english") -> Column:
    """`lexemes_of` as a column."""
    if config == "simple":
        return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))
    ship_active()
    return _english(text)


@dataclass(frozen=True)
class Node:
    """A parsed query: `and`, `or`, `not` over children, or a `phrase` of (offset, lexeme) pairs."""

    op: str
    children: tuple[Node, ...] = ()
    phrase: tuple[tuple[int, str], ...] = ()

    def lexemes(self) -> list[str]:
        """Distinct lexemes, in order."""
        found = [w for _, w in self.phrase] + [w for c in self.children for w in c.lexemes()]
        return list(dict.fromkeys(found))

    def negated(self) -> bool:
        return self.op == "not" or any(c.negated() for c in self.children)

    def matches(self, lexemes: Column) -> Column:
        """Whether an array of lexemes satisfies the query."""
        if self.op == "phrase":
            if len(self.phrase) == 1:
                return F.coalesce(F.array_contains(lexemes, self.phrase[0][1]), F.lit(False))
            first = self.phrase[0][0]
            words = [(o - first, w) for o, w in self.phrase]
            at = lambda i: [F.try_element_at(lexemes, i + (o + 1)) == w for o, w in words]

            def together(i: Column) -> Column:
                out = at(i)[0]
                for test in at(i)[1:]:
                    out = out & test
                return F.coalesce(out, F.lit(False))

            places = F.sequence(F.lit(0), F.greatest(F.size(lexemes) - 1, F.lit(0)))
            return F.array_contains(lexemes, words[0][1]) & F.exists(places, together)
        if self.op == "not":
            return ~self.children[0].matches(lexemes)
        out = self.children[0].matches(lexemes)
        for child in self.children[1:]:
            out = (out & child.matches(lexemes)) if self.op == "and" else (out | child.matches(lexemes))
        return out

    def loosened(self) -> Node:
        """The same query with AND replaced by OR; phrases stay."""
        return Node("or" if self.op == "and" else self.op, tuple(c.loosened() for c in self.children), self.phrase)


_PART = re.compile(r'(-?)"([^"]*)"?|(-?)(\S+)')


def parse_websearch(text: str, config: str = "english") -> Node | None:
    """Query of a web-search text: words are ANDed, `or` between them ORs, quotes make phrases, a leading `-`
    negates. Never raises; None when nothing but stop words remains."""
    groups: list[list[Node]] = [[]]
    pending_or = False
    alternatives: list[Node] = []
    for m in _PART.finditer(text or ""):
        negative, body = (m[1], m[2]) if m[2] is not None else (m[3], m[4])
        if m[2] is None and body.lower() == "or" and not negative:
            pending_or = bool(groups[-1])
            continue
        words = [(k, w) for k, w in enumerate(lexemes_of(body, config)) if w is not None]
        if not words:
            continue
        node = Node("phrase", phrase=tuple(words)) if m[2] is not None or len(words) > 1 else Node("phrase", phrase=(words[0],))
        node = Node("not", (node,)) if negative else node
        if pending_or:
            groups.append([node])
        else:
            groups[-1].append(node)
        pending_or = False
    for group in groups:
        if group:
            alternatives.append(group[0] if len(group) == 1 else Node("and", tuple(group)))
    if not alternatives:
        return None
    return alternatives[0] if len(alternatives) == 1 else Node("or", tuple(alternatives))


def needed_lexemes(count: int) -> int | None:
    """How many of a query's lexemes a partial match must hold; None when partial matches are off."""
    return max(2, math.ceil(count / 2)) if count > 1 else None


def cover_density(lexemes: list[str | None], wanted: list[str], every: bool) -> float:
    """Rank of a text by the shortest stretches that cover the query.

    With `every`, each minimal stretch holding all wanted lexemes adds the inverse of its surplus length; else
    every occurrence counts as a stretch of its own. More and tighter covers rank higher.
    """
    want = set(wanted)
    places = [(i, w) for i, w in enumerate(lexemes) if w in want]
    if not every:
        return 0.1 * len(places)
    score, last, low = 0.0, {}, -1
    for i, w in places:
        last[w] = i
        if len(last) == len(want):
            start = min(last.values())
            if start > low:
                score += 0.1 / (i - start - len(want) + 2)
                low = start
    return score
