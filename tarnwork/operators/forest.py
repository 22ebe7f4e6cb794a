"""Tree contraction on arrays: the same raking and splicing as in `hierarchy`, for scopes that fit in a task."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

TREE, CYCLE, BELOW = 0, 1, 2
STATES = np.array(["tree", "cycle", "below_cycle"], object)


@dataclass
class Forest:
    """Per node: root (number, -1 off trees), depth (-1 off trees), state, and its subtree's folded value.

    Paths aren't held: each node has a node `above` that was solved before it and the segment `seg` between them, so a
    path is put together from a number of segments that is logarithmic in the forest's size, and `length` is its length.
    """

    root: np.ndarray
    depth: np.ndarray
    state: np.ndarray
    folded: np.ndarray | None
    above: np.ndarray
    seg: np.ndarray | None
    length: np.ndarray | None
    separator: str

    def paths(self, nodes: np.ndarray) -> np.ndarray:
        """Labels from the root to each of `nodes`, joined; empty off trees."""
        out = np.where(self.state[nodes] == TREE, self.seg[nodes], "")
        open_, at = np.arange(len(nodes)), np.where(self.state[nodes] == TREE, self.above[nodes], -1)
        while True:
            open_ = open_[at[open_] >= 0]
            if not len(open_):
                return out
            here = at[open_]
            out[open_] = self.seg[here] + self.separator + out[open_]
            at[open_] = self.above[here]

    def slices(self, size: int) -> Iterator[np.ndarray]:
        """Runs of nodes whose paths are at most `size` characters together, or one node."""
        ends, begun = np.cumsum(self.length), 0
        while begun < len(ends):
            base = ends[begun - 1] if begun else 0
            stop = max(begun + 1, int(np.searchsorted(ends, base + size, "right")))
            yield np.arange(begun, stop)
            begun = stop


def contract_arrays(parent: np.ndarray, *, label: np.ndarray | None = None, value: np.ndarray | None = None, fold: str = "max", separator: str = "/") -> Forest:
    """Contract the forest given by `parent` (-1 at roots) and undo the contraction again.

    `label` (objects) asks for paths, `value` (floats; -inf for null with `fold='max'`) for the greatest value or, with
    `fold='sum'`, the sum of the values of each subtree.
    """
    join, none = (np.add, 0.0) if fold == "sum" else (np.maximum, -np.inf)
    n = len(parent)
    parent = parent.astype(np.int64).copy()
    me = np.arange(n)
    hops = np.ones(n, np.int64)
    seg = label.copy() if label is not None else None
    acc = value.astype(np.float64).copy() if value is not None else np.full(n, none)
    up = np.full(n, none)
    linked = (parent >= 0) & (parent != me)
    kids = np.bincount(parent[linked], minlength=n)
    active = np.flatnonzero(linked)  # nodes still to be removed
    records: list[tuple[np.ndarray, np.ndarray, np.ndarray | None, np.ndarray | None]] = []
    turn = 0
    while len(active):
        leaf = kids[active] == 0
        raked = active[leaf]
        if len(raked):
            above = parent[raked]
            records.append((raked, above, None, None))
            join.at(acc, above, join(acc[raked], up[raked]))
            np.subtract.at(kids, above, 1)
            active = active[~leaf]
        if not len(active):
            break
        only = np.full(n, -1, np.int64)
        only[parent[active]] = active
        priority = np.random.default_rng(turn).permutation(n)
        kid = only[active]
        chosen = (kids[active] == 1) & (kid >= 0) & (kid != active)
        chosen &= (priority[active] > priority[parent[active]]) & (priority[active] > priority[np.maximum(kid, 0)])
        spliced, heir = active[chosen], kid[chosen]
        if len(spliced):
            records.append((spliced, parent[spliced], heir, up[heir].copy()))
            if seg is not None:
                seg[heir] = seg[spliced] + separator + seg[heir]
            hops[heir] += hops[spliced]
            up[heir] = join(up[heir], join(acc[spliced], up[spliced]))
            parent[heir] = parent[spliced]
            gone = np.zeros(n, bool)
            gone[spliced] = True
            active = active[~gone[active] & (parent[active] != active)]
        turn += 1

    state = np.full(n, BELOW, np.int8)
    state[parent < 0] = TREE
    core = parent == me
    state[core] = CYCLE
    root = np.where(parent < 0, me, -1)
    depth = np.where(parent < 0, hops, -1)
    folded, hung = acc.copy(), np.full(n, -1, np.int64)
    length = np.array([len(x) for x in seg], np.int64) if seg is not None else None
    for nodes, above, heir, heir_up in reversed(records):
        tree = state[above] == TREE
        state[nodes] = np.where(tree, TREE, BELOW)
        if heir is not None:
            ring = (state[above] == CYCLE) & (state[heir] == CYCLE)
            state[nodes[ring]] = CYCLE
            folded[nodes] = join(acc[nodes], join(heir_up, folded[heir]))
        root[nodes] = np.where(tree, root[above], -1)
        depth[nodes] = np.where(tree, depth[above] + hops[nodes], -1)
        hung[nodes] = above
        if length is not None:
            length[nodes] += length[above] + len(separator)
    if length is not None:
        length = np.where(state == TREE, length, 0)
    return Forest(root, depth, state, folded if value is not None else None, hung, seg, length, separator)
