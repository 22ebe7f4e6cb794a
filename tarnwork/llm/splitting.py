"""Splitting oversized text blocks at natural boundaries.

A block is a row of units of one token each (a word longer than six characters is several). Between units lie
boundaries whose strength says how natural a cut there is. A sparse table over the strengths answers, for each
piece, where in the permissible window the strongest cut lies, the rightmost of equals; pieces of prose and
lists then step back by an overlap, again to the strongest boundary.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwork.runtime import arrow_map

LIMIT, OVERLAP = 320, 64
UNIT_CHARS = 6

_TOKEN = re.compile(r"\w+|[^\w\s]")
_FENCE = re.compile(r"[ \t]*(`{3,}|~{3,})")
_LIST = re.compile(r"[ \t]*(?:[-*+•]|\d{1,9}[.)]|[a-z][.)])[ \t]")
_SENTENCE_SIGNS, _CLAUSE_SIGNS, _CLOSING = ".!?…。！？", ",;:–—", "\"'”’»)]"

# Strengths of boundaries, from inside a word to an empty line.
INSIDE, GLUED, SPACE, CLAUSE, SENTENCE, LINE, ITEM, PARAGRAPH = range(8)


def count_tokens(text: str | None) -> int:
    """One token per started six characters of a run of letters, digits and `_`, and one per other character
    that is no white space."""
    return sum(-(-(m.end() - m.start()) // UNIT_CHARS) for m in _TOKEN.finditer(text or ""))


WORD, SPACED, OTHER = 1, 2, 3


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """Class of each code point: of a word, white space or another sign."""
    out = np.full(0x110000, OTHER, np.uint8)
    for code in range(0x33000):  # no letters, digits or spaces beyond
        if chr(code).isalnum() or code == 0x5F:
            out[code] = WORD
        elif chr(code).isspace():
            out[code] = SPACED
    return out


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _begins(kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where units begin, and whether a unit goes on with its word."""
    word = kind == WORD
    place = np.arange(len(kind))
    head = word & np.r_[True, ~word[:-1]] if len(kind) else word
    into = place - np.maximum.accumulate(np.where(head, place, 0)) if len(kind) else place
    return np.flatnonzero(word & (into % UNIT_CHARS == 0) | (kind == OTHER)), word & ~head


def count_all(texts: list[str]) -> np.ndarray:
    """`count_tokens` of many texts at once."""
    kind = _classes()[_codes("\n".join(texts))]
    ends = np.cumsum([len(t) + 1 for t in texts])
    begins, _ = _begins(kind)
    return np.diff(np.searchsorted(begins, np.r_[0, ends])) if len(texts) else np.zeros(0, np.int64)


def _in(codes: np.ndarray, signs: str) -> np.ndarray:
    return np.isin(codes, _codes(signs))


def units(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every unit, and the strength of the boundary before it."""
    codes = _codes(text)
    kind = _classes()[codes]
    starts, goes_on = _begins(kind)
    if not len(starts):
        return starts, starts, starts
    stop = np.flatnonzero((kind == WORD) & np.r_[kind[1:] != WORD, True])  # last letters of words
    word_end = stop[np.minimum(np.searchsorted(stop, starts), len(stop) - 1)] + 1 if len(stop) else starts
    ends = np.where(kind[starts] == WORD, np.minimum(starts + UNIT_CHARS, word_end), starts + 1)
    before = np.r_[0, ends[:-1]]
    breaks = np.r_[0, np.cumsum((codes == 10) | (codes == 13) & (np.r_[codes[1:], 0] != 10))]
    lines = breaks[starts] - breaks[before]
    # Where the sign that ends the unit before stands, closing quotes and brackets not counted.
    at = before - 1
    for _ in range(3):
        at = np.where((at > before - 4) & (at > 0) & _in(codes[np.maximum(at, 0)], _CLOSING), at - 1, at)
    sign = codes[np.maximum(at, 0)]
    same_line = np.where(_in(sign, _SENTENCE_SIGNS), SENTENCE, np.where(_in(sign, _CLAUSE_SIGNS), CLAUSE, SPACE))
    strength = np.where(lines > 1, PARAGRAPH, np.where(lines == 1, LINE, same_line))
    strength = np.where(starts == before, GLUED, strength)
    strength[goes_on[starts]] = INSIDE
    strength[0] = INSIDE
    for k in np.flatnonzero(strength == LINE).tolist():
        begin = max(text.rfind("\n", 0, starts[k]), text.rfind("\r", 0, starts[k])) + 1
        line = text[begin : starts[k] + 24]
        if _LIST.match(line) or line.lstrip().startswith(("|", "#")):
            strength[k] = ITEM
    return starts, ends, strength


class Boundaries:
    """Sparse table: the strongest boundary of any window, the rightmost or leftmost of equals."""

    def __init__(self, strength: np.ndarray, widest: int) -> None:
        place = np.arange(len(strength), dtype=np.int64)
        self.right = self._build(strength * (len(strength) + 1) + place, widest)
        self.left = self._build(strength * (len(strength) + 1) + (len(strength) - place), widest)
        self.n = len(strength)

    @staticmethod
    def _build(base: np.ndarray, widest: int) -> list[np.ndarray]:
        levels, span = [base], 1
        while span * 2 <= min(widest, len(base)):
            low = levels[-1]
            levels.append(np.maximum(low[:-span], low[span:]))
            span *= 2
        return levels

    def strongest(self, low: int, high: int, *, rightmost: bool = True) -> tuple[int, int]:
        """Place and strength of the strongest boundary in [low, high]."""
        levels = self.right if rightmost else self.left
        k = min((high - low + 1).bit_length() - 1, len(levels) - 1)
        best = int(max(levels[k][low], levels[k][high - (1 << k) + 1]))
        place = best % (self.n + 1)
        return (place if rightmost else self.n - place), best // (self.n + 1)


def kind_of(text: str, stated: str | None) -> str:
    """The stated kind, or what the text looks like."""
    if stated:
        return stated
    lines = [x for x in re.split(r"\r\n|\r|\n", text) if x.strip()]
    if lines and _FENCE.match(lines[0]):
        return "code"
    if len(lines) > 1 and all(x.lstrip().startswith("|") for x in lines[:2]):
        return "table"
    return "list" if lines and _LIST.match(lines[0]) else "paragraph"


def frame(text: str, kind: str, limit: int) -> tuple[str, str]:
    """What each later piece of code or table repeats in front (opening fence, table head), and what closes a
    piece of fenced code; empty where that would take more than a quarter of the limit."""
    lines = re.split(r"(?<=\n)|(?<=\r)(?!\n)", text)
    lead = close = ""
    if kind == "code" and (m := _FENCE.match(text)):
        lead, close = lines[0].rstrip("\r\n") + "\n", "\n" + m[1]
    elif kind == "table" and len(lines) > 2 and re.fullmatch(r"[\s|:+-]+", lines[1]):
        lead = lines[0] + lines[1]
    return (lead, close) if count_tokens(lead + close) <= limit // 4 else ("", "")


def split(text: str, *, kind: str = "paragraph", limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, int, str, int]]:
    """Pieces `(start, end, shared, piece, tokens)`: the span of the text that a piece covers, how many of its tokens
    repeat the piece before, the piece itself and its tokens, at most `limit`. Spans leave no unit out."""
    starts, ends, strength = units(text)
    n = len(starts)
    if n <= limit:
        return [(0, len(text), 0, text, n)]
    lead, close = frame(text, kind, limit)
    before, behind = count_tokens(lead), count_tokens(close)  # line ends part them from what stands between
    room = limit - before - behind
    step_back = overlap if kind not in ("code", "table") else 0
    index = Boundaries(strength, room)
    out, at, shared = [], 0, 0
    while True:
        last = n - at <= room
        cut = n if last else index.strongest(at + max(1, room // 2, shared + 1), at + room)[0]
        a, b = (0 if at == 0 else starts[at]), (len(text) if cut == n else ends[cut - 1])
        first, final = at == 0, cut == n
        body = ("" if first else lead) + text[a:b] + ("" if final else close)
        out.append((int(a), int(b), shared, body, int(cut - at) + (0 if first else before) + (0 if final else behind)))
        if last:
            return out
        back = cut
        if step_back:
            place, force = index.strongest(max(at + 1, cut - step_back), cut - 1, rightmost=False)
            back = place if force >= SPACE else cut
        at, shared = back, cut - back


def split_blocks(df: DataFrame, *, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """Every block of `df` as pieces of at most `limit` tokens.

    Columns `block_id`, `piece_no` (from 1), `n_pieces`, `heading_trail`, `piece_text`, `n_tokens`,
    `start_char`, `end_char`, `shared_tokens`. A block within the limit is one piece, unchanged; null and empty
    texts have none; a null kind is read off the text, a null trail stays null. Repeated rows give repeated
    results. Cuts prefer paragraphs, then items, lines, sentences, clauses, words; a word longer than a whole
    piece is cut inside. Code and tables repeat no content, only their fence or head.
    """
    schema = pa.schema([("block_id", pa.int64()), ("piece_no", pa.int32()), ("n_pieces", pa.int32()), ("heading_trail", pa.list_(pa.string())), ("piece_text", pa.string()), ("n_tokens", pa.int32()), ("start_char", pa.int64()), ("end_char", pa.int64()), ("shared_tokens", pa.int32())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                blocks, kinds, texts, trails = (c.to_pylist() for c in batch.slice(at, 1000).columns)
                rows: list[tuple] = []
                for k, tokens in enumerate(count_all([t or "" for t in texts]).tolist()):
                    text = texts[k]
                    if text and tokens <= limit:
                        rows.append((blocks[k], 1, 1, trails[k], text, tokens, 0, len(text), 0))
                    elif text:
                        pieces = split(text, kind=kind_of(text, kinds[k]), limit=limit, overlap=overlap)
                        rows += [(blocks[k], n, len(pieces), trails[k], piece, size, a, b, shared) for n, (a, b, shared, piece, size) in enumerate(pieces, 1)]
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], schema.field(c).type) for c in range(len(schema))], schema=schema)

    rows = df.select(F.col("block_id").cast("bigint").alias("block_id"), F.col("block_kind").cast("string").alias("kind"), F.col("block_text").cast("string").alias("text"), F.col("heading_trail").cast("array<string>").alias("trail"))
    return arrow_map(rows, cut, "block_id bigint, piece_no int, n_pieces int, heading_trail array<string>, piece_text string, n_tokens int, start_char bigint, end_char bigint, shared_tokens int")


def piece_checks(pieces: DataFrame, blocks: DataFrame, *, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """One row that says how pieces keep their promises: `n_blocks` with text, of which `n_whole` come out in one piece;
    pieces `over_limit` or counted wrongly; spans that have `left_out` more than white space
    between them; pieces `over_overlap`, with an `other_trail`, or with `wrong_numbers`. Blocks have unique ids."""
    words = F.transform(F.regexp_extract_all("piece_text", F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)), lambda w: F.ceil(F.length(w) / UNIT_CHARS).cast("int"))
    signs = F.length(F.regexp_replace("piece_text", r"[\p{L}\p{N}_\s\x0B\x1C-\x1F\x85\p{Z}]", ""))
    sized = pieces.withColumn("counted", F.aggregate(words, F.lit(0), lambda a, x: a + x) + signs)
    per = sized.groupBy("block_id").agg(
        F.max("n_pieces").alias("pieces"), F.count_if((F.col("counted") > limit) | (F.col("counted") != F.col("n_tokens"))).alias("over_limit"), F.count_if(F.col("shared_tokens") > overlap).alias("over_overlap"),
        F.array_sort(F.collect_list(F.struct("piece_no", "start_char", "end_char", "heading_trail"))).alias("spans"),
    )
    joined = per.join(blocks.select(F.col("block_id").alias("of"), "block_text", F.col("heading_trail").alias("trail")), F.col("block_id") == F.col("of"))
    gap = lambda a, b: F.substring("block_text", F.col("spans")[a]["end_char"].cast("int") + 1, F.greatest(F.lit(0), F.col("spans")[b]["start_char"].cast("int") - F.col("spans")[a]["end_char"].cast("int")))
    inner = F.transform(F.sequence(F.lit(1), F.size("spans") - 1), lambda k: F.coalesce(F.length(F.regexp_replace(gap(k - 1, k), r"[\s\x0B\x1C-\x1F\x85\p{Z}]", "")), F.lit(0)))
    lost = F.when(F.size("spans") > 1, F.aggregate(inner, F.lit(0), lambda a, x: a + x)).otherwise(0)
    edges = (F.col("spans")[0]["start_char"] != 0) | (F.element_at("spans", -1)["end_char"] != F.length("block_text"))
    return joined.agg(
        F.count("*").alias("n_blocks"), F.count_if(F.col("pieces") == 1).alias("n_whole"), F.sum("over_limit").alias("over_limit"),
        F.count_if((lost > 0) | edges).alias("left_out"), F.sum("over_overlap").alias("over_overlap"), F.count_if(F.exists("spans", lambda s: ~s["heading_trail"].eqNullSafe(F.col("trail")))).alias("other_trail"),
        F.count_if((F.size("spans") != F.col("pieces")) | ~F.forall(F.sequence(F.lit(1), F.size("spans")), lambda k: F.col("spans")[k - 1]["piece_no"] == k)).alias("wrong_numbers"),
    )
