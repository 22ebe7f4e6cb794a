"""Vectorised structural index over a batch of JSON texts.

All texts of a batch lie in one byte buffer. Bitmaps of quotes, brackets and delimiters are built with
whole-buffer operations, the inside of strings follows from the parity of quotes, nesting depth from a
prefix sum over brackets, and parents, array positions and keys from one stable sort by depth. No text is
visited by a Python loop; Python strings are made only for the distinct keys and paths of the batch.

The index decides validity strictly (RFC 8259): a text with any fault, `NaN` or a control character in a
string included, contributes nothing.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

OTHER, OBJ, OBJ_END, ARR, ARR_END, COLON, COMMA, STRING, SPACE = range(9)

_CLASS = np.zeros(256, np.uint8)
for _char, _cls in (("{", OBJ), ("}", OBJ_END), ("[", ARR), ("]", ARR_END), (":", COLON), (",", COMMA), ('"', STRING), (" ", SPACE), ("\t", SPACE), ("\n", SPACE), ("\r", SPACE)):
    _CLASS[ord(_char)] = _cls
_ESCAPABLE = np.zeros(256, bool)
_ESCAPABLE[list(b'"\\/bfnrtu')] = True
_HEX = np.zeros(256, bool)
_HEX[list(b"0123456789abcdefABCDEF")] = True
_PRIMITIVE = r"^(true|false|null|-?(0|[1-9][0-9]*)(\.[0-9]+)?([eE][+-]?[0-9]+)?)$"


def slices(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """The byte spans [start, end) of `data` as an Arrow binary array."""
    lengths = (end - start).astype(np.int64)
    offsets = np.zeros(len(start) + 1, np.int64)
    np.cumsum(lengths, out=offsets[1:])
    take = np.arange(offsets[-1]) + np.repeat(start - offsets[:-1], lengths)
    return pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(np.ascontiguousarray(data[take]).tobytes())])


def decode(raw: bytes) -> str:
    """The text of a JSON string's inside."""
    if b"\\" not in raw:
        return raw.decode("utf-8", "replace")
    text = json.loads(b'"' + raw + b'"')
    return text.encode("utf-16", "surrogatepass").decode("utf-16", "replace")


@dataclass
class JsonIndex:
    """Tokens of the valid texts of a batch, in order of position.

    `doc`, `pos`, `end`, `cls`, `lev` and `parent` are parallel: text number, byte span, class, depth and
    token number of the enclosing bracket (-1 at the top). `is_key` marks member names; `key` is the token
    number of a value's name, or -1; `place` is a value's place in its array.
    """

    data: np.ndarray
    doc: np.ndarray
    pos: np.ndarray
    end: np.ndarray
    cls: np.ndarray
    lev: np.ndarray
    parent: np.ndarray
    is_key: np.ndarray
    key: np.ndarray
    place: np.ndarray
    valid: np.ndarray

    def raw(self, tokens: np.ndarray) -> pa.Array:
        """Undecoded insides of string tokens."""
        return slices(self.data, self.pos[tokens] + 1, self.end[tokens])

    def texts(self, tokens: np.ndarray) -> list[str]:
        """Decoded string tokens."""
        return [decode(x) for x in self.raw(tokens).to_pylist()]

    def coded(self, tokens: np.ndarray) -> tuple[np.ndarray, list[str]]:
        """String tokens as numbers into a list of their distinct decoded texts."""
        if not len(tokens):
            return np.zeros(0, np.int64), []
        coded = pc.dictionary_encode(self.raw(tokens))
        texts, seen = [], {}
        to = np.zeros(len(coded.dictionary), np.int64)
        for i, x in enumerate(coded.dictionary.to_pylist()):
            text = decode(x)
            to[i] = seen.setdefault(text, len(texts))
            if to[i] == len(texts):
                texts.append(text)
        return to[coded.indices.to_numpy(zero_copy_only=False)], texts

    def member(self, names: list[str]) -> dict[str, np.ndarray]:
        """For each name, an array over tokens: the value token of that member of an object, or -1.
        Of a repeated name the last counts."""
        keys = np.flatnonzero(self.is_key)
        ids, texts = self.coded(keys)
        out = {}
        for name in names:
            value = np.full(len(self.pos), -1, np.int64)
            if name in texts:
                at = keys[ids == texts.index(name)]
                value[self.parent[at]] = at + 2
            out[name] = value
        return out


def index(texts: pa.Array) -> JsonIndex:
    """Structural index of an Arrow string array; null and empty texts are invalid."""
    n = len(texts)
    column = pc.binary_join_element_wise(pc.fill_null(texts.cast(pa.large_string()), ""), pa.scalar("\n", pa.large_string()), pa.scalar("", pa.large_string()))
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    begin, size = (int(offsets[0]), int(offsets[-1] - offsets[0])) if n else (0, 0)
    data = np.frombuffer(column.buffers()[2], np.uint8)[begin : begin + size].copy() if size else np.zeros(0, np.uint8)
    starts = (offsets[:-1] - begin).astype(np.int64) if n else np.zeros(0, np.int64)
    ends = (offsets[1:] - begin).astype(np.int64) if n else np.zeros(0, np.int64)
    valid = np.ones(n, bool)
    if not size:
        return _empty(data, n)

    # Quotes that an odd run of backslashes precedes don't end a string.
    escaped = np.zeros(size + 1, bool)
    slash = np.flatnonzero(data == 92)
    if len(slash):
        first = np.r_[True, np.diff(slash) != 1]
        start = np.maximum.accumulate(np.where(first, slash, 0))
        escaped[slash[(slash - start) % 2 == 0] + 1] = True
    escaped = escaped[:size]
    quote = (data == 34) & ~escaped
    at = np.flatnonzero(quote)
    per_doc = np.bincount(np.searchsorted(ends, at, "right"), minlength=n)
    odd = per_doc % 2 == 1
    if odd.any():
        valid &= ~odd
        for a, b in zip(starts[odd], ends[odd]):
            data[a:b], quote[a:b], escaped[a:b] = 32, False, False
        at = np.flatnonzero(quote)
    inside = (np.cumsum(quote, dtype=np.uint8) & 1).astype(bool)  # from the opening quote to before the closing

    cls_of = _CLASS[data]
    outside = ~inside & ~quote
    plain = outside & (cls_of == OTHER)
    begins = plain.copy()
    begins[1:] &= ~plain[:-1]
    token = (outside & (cls_of >= OBJ) & (cls_of <= COMMA)) | (quote & inside) | begins
    pos = np.flatnonzero(token)
    if not len(pos):
        return _empty(data, n)
    cls = cls_of[pos].astype(np.int8)
    doc = np.searchsorted(ends, pos, "right")
    end = pos + 1
    end[cls == STRING] = at[1::2]
    stops = plain.copy()
    stops[:-1] &= ~plain[1:]
    end[cls == OTHER] = np.flatnonzero(stops) + 1

    # Faults inside strings.
    bad = [np.flatnonzero(inside & (data < 32))]
    esc = np.flatnonzero(escaped & inside)
    bad.append(esc[~_ESCAPABLE[data[esc]]])
    wide = esc[data[esc] == ord("u")]
    if len(wide):
        hexes = np.ones(len(wide), bool)
        for k in range(1, 5):
            hexes &= _HEX[data[np.minimum(wide + k, size - 1)]]
        bad.append(wide[~hexes])
    for x in bad:
        valid[np.searchsorted(ends, x, "right")] = False
    bare = np.flatnonzero(cls == OTHER)
    if len(bare):
        good = pc.match_substring_regex(slices(data, pos[bare], end[bare]).cast(pa.large_string(), safe=False), _PRIMITIVE) if _ascii(data, pos[bare], end[bare]) else None
        ok = good.to_numpy(zero_copy_only=False) if good is not None else _match_each(data, pos[bare], end[bare])
        valid[doc[bare[~ok]]] = False

    # Depth; a text whose brackets don't balance is dropped before the sums run over all texts.
    step = ((cls == OBJ) | (cls == ARR)).astype(np.int64) - ((cls == OBJ_END) | (cls == ARR_END))
    count = np.bincount(doc, minlength=n)
    valid &= count > 0
    total = np.cumsum(step)
    first_token = np.r_[0, np.cumsum(count)[:-1]]
    base = np.where(first_token > 0, total[np.maximum(first_token - 1, 0)], 0)
    running = total - base[doc]
    valid[doc[running < 0]] = False
    closing_sum = np.bincount(doc, weights=step, minlength=n)
    valid &= closing_sum == 0
    keep = valid[doc]
    pos, cls, doc, end, step = pos[keep], cls[keep], doc[keep], end[keep], step[keep]

    m = len(pos)
    depth = np.cumsum(step)
    opens = step == 1
    lev = depth - opens  # an opening bracket counts as an element of what encloses it
    parent = np.full(m, -1, np.int64)
    match = np.full(m, -1, np.int64)
    place = np.zeros(m, np.int64)
    order = np.argsort(lev, kind="stable")
    bounds = np.searchsorted(lev[order], np.arange((lev.max() if m else -1) + 2))
    above = np.zeros(0, np.int64)
    for level in range(len(bounds) - 1):
        here = order[bounds[level] : bounds[level + 1]]
        if level:
            parent[here] = above[np.searchsorted(above, here) - 1]
            commas = np.cumsum(cls[here] == COMMA)
            head = np.r_[True, np.diff(parent[here]) != 0]
            base_of = np.maximum.accumulate(np.where(head, np.arange(len(here)), 0))
            place[here] = commas - commas[base_of] + (cls[here][base_of] == COMMA)
        above = here[opens[here]]
        shut = here[step[here] == -1]
        match[shut] = above[np.searchsorted(above, shut) - 1]

    # Grammar: what may follow what, given the enclosing bracket.
    same = np.r_[False, doc[1:] == doc[:-1]] if m else np.zeros(0, bool)
    prev = np.where(same, np.r_[np.int8(0), cls[:-1]], -1) if m else np.zeros(0, np.int8)
    within = np.where(parent >= 0, cls[parent], -1) if m else np.zeros(0, np.int8)
    is_key = (cls == STRING) & (within == OBJ) & ((prev == OBJ) | (prev == COMMA))
    prev_key = np.r_[False, is_key[:-1]] & same if m else is_key
    ends_value = same & ~prev_key & np.isin(prev, (STRING, OTHER, OBJ_END, ARR_END))
    starts_value = (opens | (cls == STRING) | (cls == OTHER)) & ~is_key
    ok = is_key.copy()
    ok |= starts_value & (((prev == -1) & (lev == 0)) | (prev == ARR) | ((prev == COMMA) & (within == ARR)) | (prev == COLON))
    ok |= (cls == COLON) & prev_key
    ok |= (cls == COMMA) & (lev > 0) & ends_value
    shuts = step == -1
    partner = np.where(shuts, cls[match], -9) if m else match
    ok |= shuts & (partner == cls - 1) & (ends_value | (match == np.arange(m) - 1))
    valid[doc[~ok]] = False

    key = np.where(prev == COLON, np.arange(m) - 2, -1)
    keep = valid[doc]
    if not keep.all():
        renumber = np.cumsum(keep) - 1
        to = lambda x: np.where(x >= 0, renumber[x], -1)[keep]
        parent, key = to(parent), to(key)
        pos, cls, doc, end, lev, is_key, place = (x[keep] for x in (pos, cls, doc, end, lev, is_key, place))
    return JsonIndex(data, doc, pos, end, cls, lev, parent, is_key, key, place, valid)


def _empty(data: np.ndarray, n: int) -> JsonIndex:
    none = np.zeros(0, np.int64)
    return JsonIndex(data, none, none, none, none, none, none, np.zeros(0, bool), none, none, np.zeros(n, bool))


def _ascii(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> bool:
    return bool((data[start] < 128).all()) and bool((data[end - 1] < 128).all()) and not bool(((end - start) > 4096).any())


def _match_each(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    import re

    pattern = re.compile(_PRIMITIVE.replace("$", r"\Z").encode())
    return np.array([bool(pattern.match(data[a:b].tobytes())) for a, b in zip(start, end)], bool)
