"""Markdown as blocks, and chunks of bounded token size made of them."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwork.runtime import arrow_map

_HEADING = re.compile(r"\s{0,3}(#{1,6})\s+(.*?)\s*#*\s*$")
_FENCE = re.compile(r" {0,3}(`{3,}|~{3,})")
_RULE_ROW = re.compile(r"[\s:|-]*-[\s:|-]*$")
_ITEM = re.compile(r"\s*(?:[-*+]|\d{1,9}[.)])\s+")
_WORD = re.compile(r"\w+|[^\w\s]")


@dataclass(frozen=True)
class Block:
    """A stretch of lines of one kind, below a trail of headings."""

    kind: str
    text: str
    trail: tuple[str, ...] = ()
    line: int = 0


@dataclass(frozen=True)
class Sizes:
    """Token budgets of chunks."""

    target: int = 384
    overlap: int = 64
    least: int = 32
    most: int = 480
    breadcrumb: bool = True

    @property
    def unit(self) -> int:
        return max(self.least, self.target - self.overlap)


@dataclass
class Unit:
    """A block, or a part of one, that a chunk takes whole."""

    kind: str
    text: str
    size: int
    trail: tuple[str, ...]
    goes_on: bool = False


def count_tokens(text: str, chars: int = 6) -> int:
    """One token per started six characters of a word, one per other visible character."""
    return sum(-(-(m.end() - m.start()) // chars) for m in _WORD.finditer(text))


def blocks(body: str) -> list[Block]:
    """Headings, fenced code (to the end when never closed), tables, lists and paragraphs, in order. A list or a
    paragraph goes on to a blank line or what opens a block of another kind; a list inside a paragraph doesn't."""
    lines = re.split(r"\r\n|\r|\n", body)
    out: list[Block] = []
    trail: dict[int, str] = {}
    at = 0

    def emit(kind: str, first: int, last: int) -> None:
        text = "\n".join(lines[first:last]).rstrip()
        out.append(Block(kind, text.strip() if kind == "heading" else text, tuple(trail[k] for k in sorted(trail) if trail[k]), first + 1))

    def opens_table(k: int) -> bool:
        return "|" in lines[k] and k + 1 < len(lines) and "|" in lines[k + 1] and _RULE_ROW.match(lines[k + 1]) is not None

    while at < len(lines):
        line, start = lines[at], at
        if not line.strip():
            at += 1
        elif fence := _FENCE.match(line):
            mark = fence[1]
            at += 1
            while at < len(lines) and not ((m := _FENCE.match(lines[at])) and m[1][0] == mark[0] and len(m[1]) >= len(mark) and not lines[at][m.end() :].strip()):
                at += 1
            at = min(at + 1, len(lines))
            emit("code", start, at)
        elif (heading := _HEADING.match(line)) and heading[1]:
            # A heading's own trail is the one before it: what it opens comes after.
            at += 1
            emit("heading", start, at)
            level = len(heading[1])
            trail = {k: v for k, v in trail.items() if k < level} | {level: (heading[2] or "").strip()}
        elif opens_table(at):
            while at < len(lines) and "|" in lines[at]:
                at += 1
            emit("table", start, at)
        else:
            kind = "list" if _ITEM.match(line) else "paragraph"
            at += 1
            while at < len(lines) and lines[at].strip() and not _FENCE.match(lines[at]) and not _HEADING.match(lines[at]) and not opens_table(at):
                at += 1
            emit(kind, start, at)
    return out


def _fill(parts: list[str], glue: str, room: int, size: Callable[[str], int]) -> list[str]:
    """Neighbouring parts joined as far as they fit; a part beyond the room stays alone."""
    out: list[str] = []
    for part in parts:
        if out and size(out[-1] + glue + part) <= room:
            out[-1] += glue + part
        else:
            out.append(part)
    return out


def _break(text: str, room: int, size: Callable[[str], int]) -> list[str]:
    """Text at ever finer bounds (sentences, lines, words, characters) until every part fits."""
    if size(text) <= room:
        return [text]
    for pattern, glue in ((r"(?<=[.!?…])\s+", " "), (r"\n", "\n"), (r" +", " ")):
        parts = [p for p in re.split(pattern, text) if p]
        if len(parts) > 1:
            return _fill([q for p in parts for q in _break(p, room, size)], glue, room, size)
    half = len(text) // 2
    return [text] if half == 0 else _fill(_break(text[:half], room, size) + _break(text[half:], room, size), "", room, size)


def units_of(block: Block, sizes: Sizes, size: Callable[[str], int] = count_tokens) -> list[Unit]:
    """A block as units of at most `sizes.unit` tokens: code reopens its fence, a table repeats its head."""
    if size(block.text) <= sizes.unit:
        return [Unit(block.kind, block.text, size(block.text), block.trail)]
    lines = block.text.split("\n")
    head, tail, body = [], [], lines
    if block.kind == "code":
        fence = _FENCE.match(lines[0])
        closed = len(lines) > 1 and _FENCE.match(lines[-1]) is not None
        head, tail, body = [lines[0]], [lines[-1] if closed else fence[1]], lines[1:-1] if closed else lines[1:]
    elif block.kind == "table":
        head, body = lines[:2], lines[2:]
    if head and body:
        room = max(sizes.least, sizes.unit - size("\n".join(head + tail)))
        rows = _fill([q for row in body for q in _break(row, room, size)], "\n", room, size)
        texts = ["\n".join([*head, row, *tail]) for row in rows]
    else:
        texts = _break(block.text, sizes.unit, size)
    return [Unit(block.kind, t, size(t), block.trail, k > 0) for k, t in enumerate(texts)]


def chunk(body: str | None, title: str | None = None, sizes: Sizes = Sizes(), size: Callable[[str], int] = count_tokens) -> list[tuple[str, int]]:
    """Chunks `(text, tokens)` of a body, each headed by its trail; blank bodies have none.

    Units are taken while they fit the target less the breadcrumb. The next chunk repeats trailing units within
    the overlap, but no code or table and never a whole chunk. A last chunk under the least size is joined to
    the one before where both fit the hard limit.
    """
    if not body or not body.strip():
        return []
    groups: list[list[Unit]] = []
    open_group: list[Unit] = []
    fresh = 0
    for unit in (u for b in blocks(body) for u in units_of(b, sizes, size)):
        trail = (open_group or [unit])[0].trail
        crumbs = " > ".join([t for t in ((title or "").strip(), *trail) if t])
        room = max(sizes.least, sizes.target - size(crumbs)) if sizes.breadcrumb else sizes.target
        if fresh and sum(u.size for u in open_group) + unit.size > room:
            groups.append(open_group)
            carried: list[Unit] = []
            for old in reversed(open_group):
                if old.kind in ("code", "table") or sum(u.size for u in carried) + old.size > sizes.overlap:
                    break
                carried.insert(0, old)
            open_group = carried[1:] if len(carried) == len(open_group) else carried
            fresh = 0
        open_group = [*open_group, unit]
        fresh += 1
    if fresh:
        groups.append(open_group)
    texts = [_render(g, title, sizes) for g in groups]
    if len(texts) > 1 and size(texts[-1]) < sizes.least and size(f"{texts[-2]}\n\n{texts[-1]}") <= sizes.most:
        texts[-2:] = [f"{texts[-2]}\n\n{texts[-1]}"]
    return [(t, size(t)) for t in texts]


def _render(group: list[Unit], title: str | None, sizes: Sizes) -> str:
    body = ""
    for unit in group:
        body += ("" if not body else "\n" if unit.goes_on else "\n\n") + unit.text
    crumbs = [t for t in ((title or "").strip(), *group[0].trail) if t]
    return f"{' > '.join(crumbs)}\n\n{body}" if sizes.breadcrumb and crumbs else body


def chunk_documents(df: DataFrame, *, key: str, body: str, title: str, sizes: Sizes = Sizes()) -> DataFrame:
    """`document_key, chunk_index, content, token_count` of every document; one Arrow map, no shuffle."""
    schema = pa.schema([("document_key", pa.string()), ("chunk_index", pa.int32()), ("content", pa.string()), ("token_count", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(k, i, text, n) for k, b, t in zip(*[c.to_pylist() for c in batch.columns]) for i, (text, n) in enumerate(chunk(b, t, sizes))]
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], schema.field(j).type) for j in range(4)], schema=schema)

    picked = df.select(F.col(key).cast("string").alias("k"), F.col(body).cast("string").alias("b"), F.col(title).cast("string").alias("t"))
    return arrow_map(picked, run, "document_key string, chunk_index int, content string, token_count int")


def block_rows(df: DataFrame, *, key: str, body: str) -> DataFrame:
    """`document_key, block_index, kind, text, heading_trail, start_line` of every document's blocks."""
    schema = pa.schema([("document_key", pa.string()), ("block_index", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("heading_trail", pa.list_(pa.string())), ("start_line", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(k, i, b.kind, b.text, list(b.trail), b.line) for k, text in zip(*[c.to_pylist() for c in batch.columns]) if text for i, b in enumerate(blocks(text))]
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], schema.field(j).type) for j in range(6)], schema=schema)

    return arrow_map(df.select(F.col(key).cast("string").alias("k"), F.col(body).cast("string").alias("b")), run, "document_key string, block_index int, kind string, text string, heading_trail array<string>, start_line int")
