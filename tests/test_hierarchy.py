"""Tree contraction, on arrays and by distributed rounds, against climbing parent by parent."""

import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tarnwork.operators.forest import STATES, contract_arrays
from tarnwork.operators.hierarchy import contract, descendant_counts, descendants, hierarchy
from tarnwork.operators.scoped import LIMIT


def climb(parent):
    out = []
    for k in range(len(parent)):
        chain, at = [], k
        while at >= 0 and at not in chain:
            chain.append(at)
            at = parent[at]
        if at < 0:
            out.append((chain[-1], len(chain), "/".join(str(x) for x in reversed(chain)), "tree"))
        else:
            out.append((-1, -1, "", "cycle" if at == k else "below_cycle"))
    return out


def largest(parent, value):
    out = list(value)
    for k in range(len(parent)):
        at, seen = k, set()
        while at >= 0 and at not in seen:
            seen.add(at)
            out[at] = max(out[at], value[k])
            at = parent[at]
    return out


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(-1, 30), min_size=0, max_size=30), st.integers(0, 99))
def test_arrays(raw, seed):
    parent = np.array([p if p < len(raw) else -1 for p in raw], np.int64)
    value = np.array([random.Random(seed + k).random() for k in range(len(raw))])
    got = contract_arrays(parent, label=np.array([str(k) for k in range(len(raw))], object), value=value)
    want = climb(parent.tolist())
    assert list(zip(got.root.tolist(), got.depth.tolist(), got.paths(np.arange(len(raw))).tolist(), STATES[got.state].tolist())) == want
    best = largest(parent.tolist(), value.tolist())
    assert all(got.folded[k] == best[k] for k in range(len(raw)) if want[k][3] == "tree")
    assert [len(p) for p in got.paths(np.arange(len(raw)))] == got.length.tolist()
    counted = contract_arrays(parent, value=np.ones(len(raw)), fold="sum").folded
    below = [sum(f"/{k}/" in f"/{path}/" for _, _, path, _ in want) for k in range(len(raw))]
    assert all(counted[k] == below[k] for k in range(len(raw)) if want[k][3] == "tree")


def test_long_chain_and_star():
    n = 20_000
    assert contract_arrays(np.arange(-1, n - 1)).depth.tolist() == list(range(1, n + 1))
    assert contract_arrays(np.array([-1] + [0] * n)).depth.max() == 2


def test_paths_come_in_parts():
    n = 4000
    forest = contract_arrays(np.arange(-1, n - 1), label=np.array([f"node{k}" for k in range(n)], object))
    parts = list(forest.slices(1 << 20))
    assert np.concatenate(parts).tolist() == list(range(n)) and all(forest.length[p].sum() <= 1 << 20 for p in parts) and len(parts) > 40
    last = forest.paths(parts[-1])[-1]
    assert last.split("/") == [f"node{k}" for k in range(n)]
    assert list(contract_arrays(np.zeros(0, np.int64), label=np.zeros(0, object)).slices(9)) == []


def test_distributed(spark):
    dice = random.Random(3)
    parent = [-1 if k == 0 else k - 1 if k < 40 else dice.randrange(k) if k < 120 else dice.choice([119 + (k - 119) % 3 + 1, k - 1]) for k in range(140)]
    rows = [(str(k), None if p < 0 else str(p), str(k), float(k % 17)) for k, p in enumerate(parent)]
    nodes = spark.createDataFrame(rows, "node string, parent string, label string, value double")
    got = {r["node"]: r for r in contract(nodes, fold="max").collect()}
    best = largest(parent, [r[3] for r in rows])
    for k, (root, depth, path, state) in enumerate(climb(parent)):
        r = got[str(k)]
        assert (r["root"], r["depth"], r["path"], r["state"]) == ("" if root < 0 else str(root), depth, path, state)
        if state == "tree":
            assert r["folded"] == best[k]
    ones = spark.createDataFrame([(a, b, 1) for a, b, _, _ in rows], "node string, parent string, value int")
    counted = {r["node"]: r["folded"] for r in contract(ones, paths=False, fold="sum").collect()}
    want = climb(parent)
    assert all(counted[str(k)] == sum(f"/{k}/" in f"/{path}/" for _, _, path, _ in want) for k in range(140) if want[k][3] == "tree")


BASE = datetime(2026, 1, 1)
ROWS = [
    (1, "s", " Agent-A ", None, BASE, "x"),
    (2, "s", "b", "AGENT-a", BASE, "x"),
    (3, "s", "b", "gone", BASE + timedelta(1), "x"),
    (4, "s", "c", "b", BASE, "x"),
    (5, "s", "d", "d", BASE, "x"),
    (6, "s", "e", "d", BASE, "x"),
    (7, "t", "a", " ", BASE, "x"),
    (8, "t", "b", "a", BASE, "x"),
    (8, "t", "b", "a", BASE, "x"),
    (9, None, "z", None, BASE, "x"),
    (10, "t", "", None, BASE, "x"),
    (11, "t", None, None, None, None),
]


@pytest.mark.parametrize("limit", [LIMIT, 0])
def test_hierarchy(spark, limit):
    df = spark.createDataFrame(ROWS, "record_id long, session_id string, agent_id string, parent_agent_id string, captured_at timestamp, node_path string")
    tree = hierarchy(df, limit=limit)
    got = {(r["session_id"], r["node_id"]): (r["root_id"], r["tree_depth"], r["node_path"], r["node_state"]) for r in tree.collect()}
    assert got == {
        ("s", "a"): ("a", 1, "a", "tree"),
        ("s", "b"): ("b", 1, "b", "tree"),
        ("s", "c"): ("b", 2, "b/c", "tree"),
        ("s", "d"): ("", -1, "", "cycle"),
        ("s", "e"): ("", -1, "", "below_cycle"),
        ("t", "a"): ("a", 1, "a", "tree"),
        ("t", "b"): ("a", 2, "a/b", "tree"),
    }
    assert [tuple(r) for r in descendants(tree).orderBy("session_id").collect()] == [("s", "b", "c", 1), ("t", "a", "b", 1)]
    assert {(r[0], r[1]): r[3] for r in descendant_counts(tree).collect()} == {("s", "a"): 0, ("s", "b"): 1, ("s", "c"): 0, ("t", "a"): 1, ("t", "b"): 0}
    assert hierarchy(df.limit(0), limit=limit).count() == 0


@pytest.mark.parametrize("limit", [LIMIT, 0])
def test_ids_with_separator(spark, limit):
    """Ids that hold the path's separator, or what replaces it, keep their descendants."""
    rows = [(1, "s", "a/b", None, BASE), (2, "s", "c%2f/", "a/b", BASE), (3, "s", "d%", "c%2f/", BASE)]
    tree = hierarchy(spark.createDataFrame(rows, "record_id long, session_id string, agent_id string, parent_agent_id string, captured_at timestamp"), limit=limit)
    assert {(r["node_id"], r["root_id"], r["node_path"]) for r in tree.collect()} == {("a/b", "a/b", "a/b"), ("c%2f/", "a/b", "a/b/c%2f/"), ("d%", "a/b", "a/b/c%2f//d%")}
    assert {tuple(r)[1:] for r in descendants(tree).collect()} == {("a/b", "c%2f/", 1), ("a/b", "d%", 2), ("c%2f/", "d%", 1)}
    assert {r[1]: r[3] for r in descendant_counts(tree).collect()} == {"a/b": 2, "c%2f/": 1, "d%": 0}
