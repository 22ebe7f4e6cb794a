"""Conversations against a plain rebuild in memory, by arrays and by distributed rounds."""

from datetime import datetime, timedelta

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tarnwork.llm.conversations import components, conversations, star_components

T = datetime(2026, 1, 1)
SCHEMA = "line_id long, session_id string, uuid string, parent_uuid string, line_type string, msg_role string, msg_content string, ts timestamp, ingested_at timestamp, turn_no int"


def row(n, session, uuid, parent, role, content="x", minute=None, kind=None):
    return (n, session, uuid, parent, kind, role, content, None if minute is None else T + timedelta(minutes=minute), T + timedelta(hours=n), n)


ROWS = [
    # kept: speakers spelled oddly, a system message between, a repeated row, a fork with the later branch short
    row(1, "a", "1", None, " Human", minute=0), row(2, "a", "2", "1", None, kind="assistant", minute=1), row(3, "a", "s", "2", "SYSTEM", minute=2), row(4, "a", "3", "s", "user", minute=3), row(5, "a", "4", "3", "ai", minute=4), row(5, "a", "4", "3", "ai", minute=4),
    row(6, "a", "4b", "3", "model", minute=90), row(7, "a", "5", "4", "user", minute=5), row(8, "a", "6", "5", "assistant", minute=None),
    # dropped: a missing parent, two roots, a cycle apart, no reply, assistant first, blank users, unknown speaker
    row(10, "b", "1", None, "user", minute=0), row(11, "b", "2", "gone", "assistant", minute=1),
    row(12, "c", "1", None, "user", minute=0), row(13, "c", "2", None, "assistant", minute=1),
    row(14, "d", "1", None, "user", minute=0), row(15, "d", "2", "1", "assistant", minute=1), row(16, "d", "3", "4", "user", minute=1), row(17, "d", "4", "3", "assistant", minute=1),
    row(18, "e", "1", None, "user", minute=0), row(19, "e", "2", "1", "user", minute=1), row(20, "e", "3", "2", "assistant", minute=2),
    row(21, "f", "1", None, "assistant", minute=0), row(22, "f", "2", "1", "user", minute=1), row(23, "f", "3", "2", "assistant", minute=2),
    row(24, "g", "1", None, "user", content="\u00a0\u200b ", minute=0), row(25, "g", "2", "1", "assistant", minute=1),
    row(26, "h", "1", None, "user", minute=0), row(27, "h", "2", "1", "robot", minute=1),
    row(28, "i", "1", None, "user", content='[{"type":"text","text":" "},{"type":"text"}]', minute=0), row(29, "i", "2", "1", "assistant", minute=1),
    # kept: two assistants in a row; a list with another block isn't blank; equal times at a fork
    row(30, "j", "1", None, "user", content='[{"type":"tool_result","content":""}]', minute=0), row(31, "j", "2", "1", "assistant", content="[]", minute=1), row(32, "j", "4", "2", "assistant", minute=2), row(33, "j", "3", "2", "assistant", minute=2),
    row(40, None, "1", None, "user", minute=0), row(41, None, "2", "1", "assistant", minute=1),
]
WANT = [("a", 1, "1", "user"), ("a", 2, "2", "assistant"), ("a", 3, "s", "system"), ("a", 4, "3", "user"), ("a", 5, "4b", "assistant"), ("j", 1, "1", "user"), ("j", 2, "2", "assistant"), ("j", 3, "3", "assistant")]


@pytest.mark.parametrize("limit", [50_000, 0])
def test_cases(spark, limit):
    df = spark.createDataFrame(ROWS, SCHEMA)
    assert sorted(tuple(r) for r in conversations(df, limit=limit).collect()) == WANT
    assert conversations(df.limit(0), limit=limit).count() == 0


def plain_components(n, edges):
    least = list(range(n))
    for _ in range(n):
        for a, b in edges:
            least[a] = least[b] = min(least[a], least[b])
    return least


@settings(max_examples=100, deadline=None)
@given(st.integers(1, 25), st.lists(st.tuples(st.integers(0, 24), st.integers(0, 24)), max_size=40))
def test_star_components(n, edges):
    edges = [(a % n, b % n) for a, b in edges]
    got = star_components(np.array([a for a, _ in edges], np.int64), np.array([b for _, b in edges], np.int64), n)
    assert got.tolist() == plain_components(n, edges)


def test_components_by_joins(spark):
    edges = [(f"{k:03}", f"{k + 1:03}") for k in range(40)] + [("100", "101"), ("101", "100"), ("102", "102"), (None, "1"), ("200", "000")]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "u string, v string")).collect()}
    assert got == {**{f"{k:03}": "000" for k in range(41)}, "200": "000", "100": "100", "101": "100"}
