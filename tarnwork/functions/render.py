"""Search results as text for an agent, and that text read back: a pair that must stay inverse."""

from __future__ import annotations

import re
from typing import Any

_FIELDS = ["source", "collection", "external_id", "document_id", "chunk_id", "similarity", "rrf"]
_LINE = re.compile(r"^- (\w+): (.*)$")
MARK = "=== result "


def render_results(query: str, rows: list[dict[str, Any]], *, floor: float | None = None) -> str:
    """One block per row: a header, its fields, and its content indented, so that content can't fake a header."""
    if not rows:
        return f"No results for {_line(query)!r}."
    out = [f"{len(rows)} results for {_line(query)!r}"]
    for k, row in enumerate(rows, 1):
        below = floor is not None and row.get("similarity") is not None and row["similarity"] < floor
        out.append(f"{MARK}{k}{' (below floor)' if below else ''}: {_line(row.get('title') or row.get('external_id') or '')}")
        out += [f"- {f}: {_line(row[f])}" for f in _FIELDS if row.get(f) is not None]
        out += [f"    {line}" for line in str(row.get("content") or "").splitlines()]
    return "\n".join(out)


def parse_results(text: str) -> list[dict[str, Any]]:
    """Fields of every block; ids as whole numbers, scores as numbers. Text of any other form gives none."""
    rows: list[dict[str, Any]] = []
    for line in (text or "").splitlines():
        if line.startswith(MARK):
            rows.append({"title": line.partition(": ")[2], "content": ""})
        elif rows and (m := _LINE.match(line)) and m[1] in _FIELDS and not rows[-1]["content"]:
            value: Any = m[2]
            if m[1] in ("similarity", "rrf"):
                value = float(value)
            elif m[1].endswith("_id") and m[1] != "external_id" and re.fullmatch(r"-?\d+", value):
                value = int(value)
            rows[-1][m[1]] = value
        elif rows and line.startswith("    "):
            rows[-1]["content"] += ("\n" if rows[-1]["content"] else "") + line[4:]
    return rows


def render_document(row: dict[str, Any] | None) -> str:
    """A stored document, or that there is none (which is no error)."""
    if row is None:
        return "No such document."
    return "\n".join([f"# {_line(row.get('title') or row['external_id'])}", *[f"- {f}: {_line(row[f])}" for f in ("source", "collection", "external_id") if row.get(f)], "", str(row.get("body") or "")])


def _line(value: Any) -> str:
    return re.sub(r"\s+", " ", str(value)).strip()
