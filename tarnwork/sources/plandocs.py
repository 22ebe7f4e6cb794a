"""Plan documents: requirement sections, checkboxes, fields and phase tables."""

from __future__ import annotations

import re
from collections.abc import Iterator
from pathlib import PurePosixPath

import pyarrow as pa
from pyspark.sql import DataFrame

from tarnwork.runtime import arrow_map

_FENCE = re.compile(r" {0,3}(`{3,}|~{3,})")
_HEADING = re.compile(r" {0,3}(#{1,6})\s+(.*?)\s*#*$")
_ID = re.compile(r"[A-Z]{1,6}-?\d{1,4}[a-z]?$")
_BOX = re.compile(r"(\s*)[-*+]\s+\[([ xX])\]\s+(.*)$")
_FIELD = re.compile(r"(\s*)(?:[-*+]\s+)?\**(Done when|Tests)\**\s*:\**\s*(.*)$", re.I)
_ROW = re.compile(r"\s*\|(.+)\|\s*$")
_RULE = re.compile(r"[\s|:-]+$")


def parse(text: str, source: str) -> list[dict]:
    """Rows `kind` (requirement, checkbox, field, phase or brief), `owner`, `name`, `text`, `checked`, `line`.

    A heading whose first word is an id opens a requirement, up to a heading of its level or above. What stands
    in fenced code doesn't count. An item's text goes on over deeper indented lines. Without requirements the
    document is a brief, named by the phase in its file name.
    """
    lines = re.split(r"\r\n|\r|\n", text)
    rows: list[dict] = []
    open_at: list[tuple[int, str]] = []  # level and id of enclosing requirements
    titles: list[tuple[int, str]] = []
    fence = None
    head: list[str] | None = None  # columns of the table being read
    for at, line in enumerate(lines):
        mark = _FENCE.match(line)
        if fence or mark:
            fence = None if fence and mark and mark[1].startswith(fence) else fence or mark[1]
            continue
        if row := _ROW.match(line):
            cells = [c.strip() for c in row[1].split("|")]
            if head is None:
                follows = lines[at + 1] if at + 1 < len(lines) else ""
                head = [c.lower() for c in cells] if _RULE.match(follows) and "-" in follows else None
            elif not _RULE.match(line) and "phase" in head[0]:
                rows.append({"kind": "phase", "owner": None, "name": cells[0], "text": " | ".join(cells[1:]), "checked": None, "line": at + 1})
            continue
        head = None
        if heading := _HEADING.match(line):
            level, words = len(heading[1]), heading[2]
            open_at = [(k, v) for k, v in open_at if k < level]
            first, _, rest = words.partition(" ")
            if _ID.match(first):
                outer = next((t for k, t in reversed(titles) if k < level and k > 1), None)
                rows.append({"kind": "requirement", "owner": outer, "name": first, "text": rest.strip(), "checked": None, "line": at + 1})
                open_at.append((level, first))
            titles.append((level, words))
            continue
        owner = open_at[-1][1] if open_at else None
        if box := _BOX.match(line):
            rows.append({"kind": "checkbox", "owner": owner, "name": None, "text": _item(lines, at, box[3], len(box[1])), "checked": box[2] != " ", "line": at + 1})
        elif owner and (field := _FIELD.match(line)):
            name = field[2].lower()
            if not any(r["kind"] == "field" and r["owner"] == owner and r["name"] == name for r in rows):
                rows.append({"kind": "field", "owner": owner, "name": name, "text": _item(lines, at, field[3], len(field[1])), "checked": None, "line": at + 1})
    if not any(r["kind"] == "requirement" for r in rows):
        stem = PurePosixPath(source.replace("\\", "/")).stem
        m = re.search(r"(PHASE\d+)", stem, re.I)
        brief = m[1].upper() if m else stem
        rows = [{**r, "owner": r["owner"] or brief} if r["kind"] == "checkbox" else r for r in rows]
        rows.insert(0, {"kind": "brief", "owner": None, "name": brief, "text": next((t for k, t in titles if k == 1), stem), "checked": None, "line": 1})
    return rows


def _item(lines: list[str], at: int, first: str, indent: int) -> str:
    parts = [first.strip()]
    for line in lines[at + 1 :]:
        depth = len(line) - len(line.lstrip())
        if not line.strip() or depth <= indent:
            break
        if re.match(r"\s*[-*+]\s", line) and depth <= indent:
            break
        parts.append(line.strip())
    return " ".join(p for p in parts if p)


_SCHEMA = pa.schema([("source", pa.string()), ("kind", pa.string()), ("owner", pa.string()), ("name", pa.string()), ("text", pa.string()), ("checked", pa.bool_()), ("line", pa.int32())])


def parse_documents(df: DataFrame, *, source: str = "source", text: str = "text") -> DataFrame:
    """`parse` over a table of documents, one row per element."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [{"source": s, **r} for s, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if t is not None for r in parse(t, s or "")]
            yield pa.RecordBatch.from_arrays([pa.array([r[f.name] for r in rows], f.type) for f in _SCHEMA], schema=_SCHEMA)

    return arrow_map(df.selectExpr(f"CAST({source} AS string)", f"CAST({text} AS string)"), run, "source string, kind string, owner string, name string, text string, checked boolean, line int")


def id_collisions(requirements: DataFrame) -> DataFrame:
    """Requirement ids with differing titles: the first title and each other one."""
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    first = F.first("text").over(Window.partitionBy("name").orderBy("source", "line").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return requirements.filter("kind = 'requirement'").withColumn("first_text", first).filter("text != first_text").select("name", "first_text", "source", "line", "text")
