"""Candidates for personal items: spans of a text that a grammar admits, with the kinds they could be.

The grammars are wide on purpose (every date, version or code name that looks alike becomes a candidate);
the field of `pii_field` decides. Candidates of a text don't overlap.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import accumulate
from typing import NamedTuple

from tarnwork.llm import pii_lexicon as L

EMAIL, NUMBER, ADDRESS, NAME = range(4)


class Candidate(NamedTuple):
    start: int
    end: int
    sort: int


_AT = r"(?:@|＠|%40|&#64;|\s?[\[({<]\s?(?:at|AT|At|@|a|ät|arroba|arobase)\s?[\])}>]\s?)"
_DOT = r"(?:\.|\s?[\[({<]\s?(?:dot|DOT|Dot|punkt|Punkt|point|punto|\.)\s?[\])}>]\s?)"
_LOCAL = r"[\w!%+-]+(?:(?:\.|\s?[\[({]\s?(?:dot|DOT|punkt|point|punto)\s?[\])}]\s?)[\w!%+-]+)*"
_LABEL = r"[^\W_](?:[\w-]*[^\W_])?"
_EMAIL = re.compile(rf"(?<![\w.+%-]){_LOCAL}{_AT}{_LABEL}(?:{_DOT}{_LABEL})*")
_SPOKEN = re.compile(rf"(?<![\w.+%-])[\w.+%-]+ (?:at|AT|arroba|arobase) {_LABEL}(?:(?: (?:dot|DOT|punkt|point|punto) ){_LABEL})+")

_NUMBER = re.compile(
    r"(?<![\w.@#$€£/+*-])(?<!\d[ ,:])"
    r"(?:\+ ?|00)?(?:\(\+?\d{1,5}\) ?|\d++)(?:(?:(?: ?[-/‐-―] ?|[ . ])(?:\(\d{1,5}\)[ .\-/]{0,2})?|\(\d{1,5}\)[ .\-/]{0,2}|(?<=\)) ?)\d++)*"
    r"(?:(?:,? ?(?:ext|Ext|EXT|Durchwahl|poste|extensión|extension)\.? ?|,? ?x ?)\d{1,6})?(?![\w@]|-\w)"
)
_CODE = re.compile(r"(?<![\w/.-])(?:[A-Z]{1,3}-?\d{6,10}[A-Z]?|[A-Z]\d{2}[A-Z]{2}\d{4,6}|[A-Z]\d[A-Z0-9]{5,9}\d|[XYZ]-?\d{7}-?[A-Z]|\d{7,8}-?[A-Z]|\d{2} ?[A-Z]{2} ?\d{5}|[A-CEGHJ-PR-TW-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-D])(?![\w/-])")
_DIGITS = re.compile(r"\d")
_DATE = re.compile(r"(?:19|20)\d\d-\d\d-\d\d$|\d{1,3}(?:\.\d{1,3}){3}$|(?:19|20)\d\d-\d\d-\d\d[ T]\d+")

_CAP = r"[^\W\d_a-zà-öø-ÿ]\w*(?:['’]\w+)*(?:-\w+(?:['’]\w+)*)*"
_LINK = r"(?:am|an der|an|auf der|auf|bei|im|in|sur|sous|la|le|les|lès|de la|de los|de las|del|de|du|des|der|den|en|et|y)"
_TOWN = rf"{_CAP}(?:[ -](?:{_LINK}[ -]){{0,3}}{_CAP}){{0,6}}"
_UNIT = r"(?:(?:Apt|Apartment|Unit|Flat|Suite|Ste|Room|Rm|Floor|Fl|Wohnung|Whg|App|Appt|Apto|Bât|Bâtiment)\.? ?#?\w{1,6}|#\s?\w{1,6}|bajo|ático|entlo\.?|\d{1,2}\.?[ºª°](?: ?(?:[A-Z]\b|izq\.?|dcha\.?))?|\d{1,2}(?:st|nd|rd|th) [Ff]loor)"
_POST = r"(?:[A-Z]{2},? \d{5}(?:-\d{4})?|\d{5}|[A-Z]{1,2}\d[A-Z\d]? ?\d[A-Z]{2})"
_SEP = r"(?:, ?|,?[ \t]*\r?\n[ \t]*| )"
_HEADS = [
    rf"(?<![\w.,/#-])\d{{1,5}}[a-zA-Z]?(?: 1/2)? (?:St\. )?(?:{_CAP} ){{1,4}}?(?:{L.STREET_EN})\b(?:\.(?=,))?(?: (?:N|S|E|W|NE|NW|SE|SW|North|South|East|West)\b)?",
    rf"(?:(?<![\w-]){_CAP}(?:[ -]{_CAP}){{0,5}}?[ -]?(?:{L.STREET_DE}|(?:Straße|Strasse|Str\.|Gasse|Platz|Weg|Allee|Damm|Ufer|Ring)) ?\d{{1,4}} ?[a-z]?\b)",
    rf"(?<![\w-])(?:{L.STREET_DE_OPEN}) (?:{_CAP} )?{_CAP} \d{{1,4}} ?[a-z]?(?![\w.])",
    rf"(?<![\w.,/#-])\d{{1,4}}(?: ?(?:bis|ter|quater|[a-dA-D]))?,? (?:{L.STREET_FR}) (?:(?:de la|de l['’]|des|du|de|d['’]|la|le|les|l['’]) ?)*{_CAP}(?:[ -](?:(?:de la|des|du|de|et|la|le) )?{_CAP})*",
    rf"(?<![\w-])(?:{L.STREET_ES}) ?(?:(?:de las|de los|de la|del|de|la|las|los|el) )*{_CAP}(?:[ -](?:(?:de la|de los|de las|del|de|y) )?{_CAP})*,? (?:n[.ºo°]+ ?)?\d{{1,4}}(?: ?(?:bis|[a-zA-Z]))?(?![\w])",
]
_HEAD = re.compile("|".join(f"(?:{x})" for x in _HEADS))
_UNIT_TAIL = re.compile(rf"{_SEP}(?:{_UNIT})(?!\w)")
_POST_FIRST = re.compile(rf"{_SEP}(?:[A-Z]{{1,2}}-)?\d{{4,5}}{_SEP.replace('(?:', '(?:')}{_TOWN}")
_TOWN_POST = re.compile(rf"{_SEP}{_TOWN}(?:, ?|,?[ \t]*\r?\n[ \t]*| ){_POST}(?!\w)")
_TOWN_ONLY = re.compile(rf"(, ?|,?[ \t]*\r?\n[ \t]*)((?:(?:Port|Saint|St\.|Bad|New|San|Santa|El|La|Le|Los|Las|Fort|Mount|North|South|East|West|Upper|Lower|Great|Little) )?{_CAP})")

_WORD = r"(?:[^\W\d_]['’])?[^\W\d_][^\W\d_]*(?:['’][^\W\d_]{2,})*(?:-[^\W\d_][^\W\d_'’]*)*"
_PARTICLE = "|".join(sorted((p.replace(".", r"\.").replace(" ", " +") for p in L.PARTICLES), key=len, reverse=True))
_UP = r"(?=[^\W\d_a-zß-öø-ÿ])"
_RUN = re.compile(
    rf"(?<![\w/.~#-])(?<!\w@)(?<!\\)(?:(?:(?i:{_PARTICLE}) +){{0,4}}{_UP}{_WORD},[ \t]+{_UP}(?:{_WORD}\b(?!\.\w)|[^\W\d_]\.)(?:[ \t]+{_UP}[^\W\d_]\.)*"
    rf"|(?:{_UP}(?:[^\W\d_]\.[ \t]?|{_WORD}[ \t]+)){{1,8}}(?:(?:(?i:{_PARTICLE})[ \t]+){{0,4}}{_UP}(?:{_WORD})))"
)
_TOKEN = re.compile(rf"[^\W\d_]\.|{_WORD}")
# Lower-case names. A word or initial of a name, the sign between two of them, and a run of those.
_LOW = r"(?:[^\W\d_]['’])?[^\W\d_]{2,}(?:['’][^\W\d_]{2,})*(?:-[^\W\d_]+(?:['’][^\W\d_]+)*)*"
_LOWER_RUN = re.compile(rf"(?<![\w/.~#@\\-])(?:{_LOW}|[^\W\d_]\.)(?:(?:,[ \t]+|[ \t]+)(?:{_LOW}(?![\w@/\\]|[.-]\w)|[^\W\d_]\.))+")
_LOWER_PART = re.compile(rf"({_LOW}|[^\W\d_]\.)(,?)")


@lru_cache(maxsize=1 << 16)
def fold(word: str) -> str:
    """Lower case without accents, for look-up in word lists."""
    return "".join(c for c in unicodedata.normalize("NFKD", word.lower().replace("ø", "o").replace("ß", "ss")) if not unicodedata.combining(c))


def is_given(word: str) -> bool:
    head = fold(word).split("-")[0]
    return head in L.GIVEN


def candidates(text: str, common: frozenset[str] = frozenset()) -> list[Candidate]:
    """Candidates in order of position. Of overlapping ones e-mail wins over address, address over number,
    number over name. A word of `common` (ordinary words in lower case) that opens a sentence begins no name."""
    found: list[Candidate] = []
    if "@" in text or "＠" in text or "%40" in text or "&#64;" in text or "at" in text or "AT" in text or "(a" in text or "[a" in text:
        if _HAS_AT.search(text):
            found += [Candidate(m.start(), m.end(), EMAIL) for m in _EMAIL.finditer(text)]
            found += [Candidate(m.start(), m.end(), EMAIL) for m in _SPOKEN.finditer(text)]
    taken = sorted(found)
    has_digit = _DIGITS.search(text)
    if has_digit:
        taken = _add(taken, (Candidate(m.start(), _tail(text, m.end()), ADDRESS) for m in _HEAD.finditer(text)))
        taken = _add(taken, (Candidate(m.start(), m.end(), NUMBER) for m in _NUMBER.finditer(text) if m.end() - m.start() >= 8 and len(_DIGITS.findall(m[0])) >= 8 and not _DATE.match(m[0])))
        taken = _add(taken, (Candidate(m.start(), m.end(), NUMBER) for m in _CODE.finditer(text)))
    return _add(taken, _names(text, common))


_HAS_AT = re.compile(r"@|＠|%40|&#64;|[\[({<]\s?(?:at|AT|At|a|ät|arroba|arobase)\s?[\])}>]| (?:at|AT|arroba|arobase) [\w-]+ (?:dot|DOT|punkt|point|punto) ")


def _add(taken: list[Candidate], more: Iterable[Candidate]) -> list[Candidate]:
    """`taken` (in order) and those of `more` that overlap none of them nor each other, the first first."""
    out, k, end = list(taken), 0, -1
    reach = list(accumulate((t.end for t in taken), max))  # taken ones may overlap among themselves
    for c in sorted(more):
        while k < len(taken) and taken[k].start < c.end:
            k += 1
        if c.start >= end and (not k or reach[k - 1] <= c.start):
            out.append(c)
            end = c.end
    return sorted(out)


def _tail(text: str, at: int) -> int:
    """End of an address that begins before `at`: unit, town, state and postcode where they follow."""
    if m := _UNIT_TAIL.match(text, at):
        at = m.end()
    if m := _POST_FIRST.match(text, at):
        return m.end()
    if (m := _TOWN_POST.match(text, at)) and not _sentence(m[0]):
        return m.end()
    if m := _TOWN_ONLY.match(text, at):
        word = m[2].split()[0]
        after = text[m.end() : m.end() + 1]
        known = (" " in m[2] or fold(word) not in L.STARTERS) and fold(word) not in L.TITLES and not is_given(m[2].split()[-1]) and not word.isupper()
        line = "\n" in m[1]
        ends = after in (",", ".", ":", ";", ")", "'", '"', "\n", "") or not line and after == " " and text[m.end() + 1 : m.end() + 2].islower()
        ends = ends or (line and re.match(r" (?:last|is|now|on|since|and|ist|est|es|y|et|und|seit|por)\b", text[m.end() : m.end() + 8]) is not None)
        if known and ends and not (after == "." and re.match(r"\.[a-z]", text[m.end() : m.end() + 2])):
            return m.end()
    return at


def _sentence(tail: str) -> bool:
    words = re.findall(r"[^\W\d_]+", tail)
    return bool(words) and (fold(words[0]) in L.STARTERS or is_given(words[0])) or any(fold(w) in L.STARTERS and w[0].isupper() for w in words[1:3] if len(w) > 2)


def _names(text: str, common: frozenset[str]) -> Iterator[Candidate]:
    at = 0
    while m := _RUN.search(text, at):
        at = m.end()
        spans = _split_run(text, m.start(), m.end(), common)
        if not spans:
            # Look again behind the first word, as a later word may begin a name.
            first = _TOKEN.search(text, m.start())
            at = max(first.end() if first else m.end(), m.start() + 1)
            continue
        for a, b in spans:
            yield Candidate(a, b, NAME)
        at = max(spans[-1][1], m.start() + 1)
    yield from _lower_names(text)


def _lower_names(text: str) -> Iterator[Candidate]:
    """Lower-case names: a given name of the list (whatever its accents) or an initial with a family name, in
    either order, and else any two neighbouring words that aren't function words."""
    for m in _LOWER_RUN.finditer(text):
        parts = [(m.start() + p.start(1), m.start() + p.end(1), p[1], bool(p[2])) for p in _LOWER_PART.finditer(m[0])]
        kinds = [_lower_kind(p[2]) for p in parts]
        for k in range(len(parts) - 1):
            if parts[k][2][0] + parts[k + 1][2][0] in _ABBREVIATIONS and kinds[k] == kinds[k + 1] == "initial":
                kinds[k] = kinds[k + 1] = "stop"
        free, k = [True] * len(parts), 0
        while k < len(parts):
            # First what holds a known given name or an initial.
            end = _lower_known(parts, kinds, k)
            if end:
                yield Candidate(parts[k][0], parts[end - 1][1], NAME)
                free[k:end] = [False] * (end - k)
                k = end
            else:
                k += 1
        k = 0
        while k + 1 < len(parts):
            if free[k] and free[k + 1] and kinds[k] == kinds[k + 1] == "word" and not parts[k][3]:
                yield Candidate(parts[k][0], parts[k + 1][1], NAME)
                k += 1
            k += 1


# Letters of abbreviations that look like initials (e. g., i. e., z. b., d. h., u. a.).
_ABBREVIATIONS = {"eg", "ie", "zb", "dh", "ua"}


@lru_cache(maxsize=1 << 16)
def _lower_kind(word: str) -> str:
    if not word.islower():
        return "none"
    if word[-1] == ".":
        return "initial"
    plain = fold(word)
    if is_given(word):
        return "given"
    if plain in _PARTICLE_WORDS:
        return "particle"
    return "stop" if plain in L.STARTERS or plain in L.TITLES or plain in L.NUMBER_WORDS or plain in L.DAYS else "word"


def _lower_known(parts: list[tuple[int, int, str, bool]], kinds: list[str], k: int) -> int:
    """End of the name that begins at part `k`, 0 if none does."""
    n = len(parts)

    def family(at: int) -> int:
        last = min(at + 4, n)  # no name has more particles
        while at < last and kinds[at] == "particle" and not parts[at][3]:
            at += 1
        return at + 1 if at < n and kinds[at] in ("word", "given") else 0

    if kinds[k] in ("given", "initial"):
        at = k + 1
        while not parts[at - 1][3] and at < n and (kinds[at] == "initial" or kinds[at] == "given" and kinds[k] == "given" and at == k + 1 and family(at + 1) and not parts[at][3]):
            at += 1
        if not parts[at - 1][3] and (end := family(at)):
            return end
    if kinds[k] == "word" and not parts[k][3] and k + 1 < n and kinds[k + 1] == "initial":
        at = k + 1
        while at < n and kinds[at] == "initial" and not parts[at][3]:
            at += 1
        if end := family(at):
            return end
    end = family(k)
    if end and end < n and parts[end - 1][3] and kinds[end] in ("given", "initial"):
        while not parts[end][3] and end + 1 < n and kinds[end + 1] == "initial":
            end += 1
        return end + 1
    if end and end < n and end == k + 1 and kinds[k] == "word" and kinds[end] == "given" and (end + 1 == n or parts[end][3] or kinds[end + 1] not in ("word", "particle", "given")):
        return end + 1
    return 0


def is_object(name: str) -> bool:
    """Whether a name-like span is a day, a label of a number, or ends in a common noun that isn't in use as a
    family name."""
    last = fold(name.split(",")[0].split()[-1])
    if last in L.NUMBER_WORDS or fold(name.split()[0]) in L.DAYS:
        return True
    return (last in L.CODE or last.removesuffix("s") in L.CODE) and last not in L.SURNAME_NOUNS and last.removesuffix("s") not in L.SURNAME_NOUNS


_PARTICLE_WORDS = {w for p in L.PARTICLES for w in p.split()}
_PARTICLE_HEADS = {p.split()[0].strip(".") for p in L.PARTICLES}
_HONORIFICS = (L.TITLES | L.STARTERS) - set(L.PARTICLES)


_OPENS = re.compile(r"(?:^|[.!?:;\n\r][\s\"'“‘(*-]*)$")


def _split_run(text: str, start: int, end: int, common: frozenset[str]) -> list[tuple[int, int]]:
    """The name-like part of a run of capitalised words: titles and sentence openers are left out in front,
    and with a known given name or initial the name begins there."""
    run = text[start:end].rstrip()
    end = start + len(run)
    if "," in run:
        head, tail = run.split(",", 1)
        first = head.split()
        last_given = _TOKEN.findall(tail)
        if not last_given or not (is_given(last_given[0]) or re.fullmatch(r"[^\W\d_]\.", last_given[0])):
            return []
        skip = 0
        while len(first) > 1 and fold(first[0].strip(".")) in _HONORIFICS:
            skip += len(first[0]) + 1
            first = first[1:]
        if fold(first[-1]) in L.STARTERS or (is_given(first[-1]) and len(first) == 1 and len(last_given) == 1 and not text[end : end + 1].isspace()):
            return []
        return [(start + skip, end)]
    tokens = [(start + m.start(), start + m.end(), m[0]) for m in _TOKEN.finditer(run)]
    while tokens and (fold(tokens[0][2]) in L.STARTERS or fold(tokens[0][2]).strip(".") in L.TITLES and tokens[0][2] != "M." or tokens[0][2][0].islower()):
        tokens = tokens[1:]
    for k, t in enumerate(tokens):
        if (is_given(t[2]) or (re.fullmatch(r"[^\W\d_]\.", t[2]) and (k == 0 or tokens[k - 1][2][0].isupper()))) and k + 1 < len(tokens):
            if k and re.fullmatch(r"[^\W\d_]\.", t[2]):
                continue  # an initial after an unknown given name
            tokens = tokens[k:]
            break
    known = any(is_given(t[2]) for t in tokens)
    plain = [t for t in tokens if t[2][0].isupper() and not t[2].endswith(".")]
    if len(tokens) > 2 and plain and plain[0] == tokens[0] and _OPENS.search(text[max(0, tokens[0][0] - 40) : tokens[0][0]]):
        # What opens a sentence before two more parts of a name is rather no name: an ordinary word, or one of three.
        if tokens[0][2].lower() in common and not is_given(tokens[0][2]) or len(plain) > 2 and not known:
            tokens = tokens[1:]
    # A name ends with the first family word behind the given names, initials and particles.
    out = []
    for k, t in enumerate(tokens):
        out.append(t)
        plain = not re.fullmatch(r"[^\W\d_]\.", t[2]) and t[2].lower() not in _PARTICLE_HEADS
        if k >= 1 and plain and not (is_given(t[2]) and k + 1 < len(tokens) and k < 2 and is_given(tokens[0][2])):
            break
    if len(out) < 2 or re.fullmatch(r"[^\W\d_]\.", out[-1][2]) or out[-1][2].lower() in _PARTICLE_HEADS:
        return []
    return [(out[0][0], out[-1][1])]
