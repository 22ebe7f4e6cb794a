"""Parent-child links to full hierarchies by distributed tree contraction.

Every round rakes all leaves and splices out an independent set of unary nodes (nodes with one child, no
leaf, whose priority beats parent's and child's), so the number of nodes falls geometrically whatever the
shape: bushy trees by raking, long chains by splicing. Each removal is recorded with the parent it hangs
below at that time and the path segment between them. What can't be contracted are roots and, for each
cycle, one node that has become its own parent. The recorded removals are then undone in reverse order: a
node's parent is always solved before it, which yields root, depth and path by one equi-join a round.

All joins are on unique node keys or from many nodes to their parent, so no group is ever collected; the
sum of all rounds' input is a constant times the number of nodes. Scopes of at most `scoped.LIMIT` bytes don't
need rounds of jobs: they are contracted by the same steps on arrays, many scopes at once in a task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnwork.operators.forest import STATES, contract_arrays
from tarnwork.operators.forest import TREE as TREE_STATE
from tarnwork.operators.scoped import LIMIT, map_scopes, positions, split_by_size
from tarnwork.runtime import cut_lineage, cut_lineage_counting

TREE, CYCLE, BELOW = "tree", "cycle", "below_cycle"
#: Characters of paths that a task gives out at a time.
PATH_CHARS = 16 << 20


def _priority(node: str) -> Column:
    # The round's number is a column, not a literal, so that all rounds share one compiled plan.
    return F.xxhash64(F.col(node), F.col("turn"))


@dataclass(frozen=True)
class Fold:
    """How values of a subtree are put together: `max` or `sum`."""

    name: str = "max"

    def two(self, a: str, b: str) -> Column:
        return F.greatest(a, b) if self.name == "max" else F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))

    def all(self, column: Column) -> Column:
        return F.max(column) if self.name == "max" else F.sum(column)


def contract(nodes: DataFrame, *, paths: bool = True, separator: str = "/", fold: str | None = None, max_rounds: int = 400) -> DataFrame:
    """Root, depth and path of every node of a forest with possible cycles.

    `nodes` has unique `node`, `parent` (null at a root, else the key of a present node) and, with `paths`,
    `label`; with `fold` a `value`, orderable or, for sums, an integer. Result: `node`, `root`, `depth` (1 at the root),
    `path` (labels from the root, joined) and `state`; for nodes on or below a cycle root and path are `''`, depth
    -1. With `fold` also `folded`, the greatest non-null `value` (`max`) or the sum (`sum`) of the node's subtree
    (trees only). An empty input gives an empty result.
    """
    how = Fold(fold or "max")
    label = F.col("label").cast("string") if paths else F.lit("")
    value = F.lit(None).cast("int") if fold is None else F.col("value").cast("bigint") if fold == "sum" else F.col("value")
    kids = nodes.filter(F.col("parent").isNotNull() & (F.col("parent") != F.col("node"))).groupBy(F.col("parent").alias("of")).agg(F.count("*").alias("kids"))
    state = nodes.join(kids, F.col("node") == F.col("of"), "left").select("node", "parent", label.alias("seg"), F.lit(1).alias("hops"), F.coalesce("kids", F.lit(0)).alias("kids"), value.alias("acc"), value.alias("up"), F.lit(0).alias("turn"))
    state = state.withColumn("up", F.when(F.lit(False), F.col("up")))

    rounds: list[DataFrame] = []
    for _ in range(max_rounds):
        state, left, removed = _round(state, how)
        if removed:
            rounds.append(state.filter(F.col("fate") != "stay"))
        state = _spliced(state, separator if paths else "", how)
        if not left:
            break
    else:
        raise RuntimeError(f"not contracted after {max_rounds} rounds")

    at_root = F.col("parent").isNull()
    solved = [cut_lineage(state.select("node", F.when(at_root, F.col("node")).otherwise("").alias("root"), F.when(at_root, F.col("hops")).otherwise(-1).alias("depth"), F.when(at_root, F.col("seg")).otherwise("").alias("path"), F.when(at_root, TREE).otherwise(CYCLE).alias("state"), F.col("acc").alias("folded")), "core")]
    for records in reversed(rounds):
        solved.append(cut_lineage(_undo(records, _union(solved), separator if paths else "", how), "undone"))
    result = _union(solved)
    keep = ["node", "root", "depth", "state"] + ["path"] * paths + ["folded"] * bool(fold)
    return result.select(*keep)


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _round(state: DataFrame, how: Fold) -> tuple[DataFrame, int, int]:
    """One round's fates (`rake` for leaves, `splice` for chosen unary nodes, `stay` for the rest), written; how
    many nodes stay that aren't contracted yet, and how many don't stay."""
    has_parent = F.col("parent").isNotNull() & (F.col("parent") != F.col("node"))
    leaf = F.col("kids") == 0
    below = state.filter(has_parent).groupBy(F.col("parent").alias("of")).agg(
        F.count_if(~leaf).alias("alive"),
        F.max(F.when(~leaf, F.struct("node", "up"))).alias("kid"),
        how.all(F.when(leaf, how.two("acc", "up"))).alias("leaf_acc"),
    )
    joined = state.join(below, F.col("node") == F.col("of"), "left").select(
        "node", "parent", "seg", "hops", "up", how.two("acc", "leaf_acc").alias("acc"), "kids", F.coalesce("alive", F.lit(0)).alias("alive"), F.col("kid.node").alias("kid"), F.col("kid.up").alias("kid_up"), "turn"
    )
    mine = _priority("node")
    chosen = has_parent & (F.col("alive") == 1) & (F.col("kids") == 1) & (F.col("kid") != F.col("node")) & (mine > _priority("parent")) & (mine > _priority("kid"))
    fated = joined.withColumn("fate", F.when(has_parent & leaf, "rake").when(chosen, "splice").otherwise("stay"))
    stays = F.col("fate") == "stay"
    written, seen = cut_lineage_counting(fated, "round", left=F.count_if(stays & has_parent), removed=F.count_if(~stays))
    return written, seen["left"], seen["removed"]


def _spliced(state: DataFrame, separator: str, how: Fold) -> DataFrame:
    """The nodes that stay, children of spliced nodes hung below their grandparent."""
    gone = state.filter(F.col("fate") == "splice").select(F.col("kid").alias("heir"), F.col("parent").alias("above"), F.col("seg").alias("gone_seg"), F.col("hops").alias("gone_hops"), how.two("acc", "up").alias("gone_acc"))
    moved = F.col("heir").isNotNull()
    return state.filter(F.col("fate") == "stay").join(gone, F.col("node") == F.col("heir"), "left").select(
        "node",
        F.when(moved, F.col("above")).otherwise(F.col("parent")).alias("parent"),
        F.when(moved, F.concat("gone_seg", F.lit(separator), "seg")).otherwise(F.col("seg")).alias("seg"),
        (F.col("hops") + F.coalesce("gone_hops", F.lit(0))).alias("hops"),
        F.col("alive").alias("kids"),
        "acc",
        how.two("up", "gone_acc").alias("up"),
        (F.col("turn") + 1).alias("turn"),
    )


def _undo(records: DataFrame, solved: DataFrame, separator: str, how: Fold) -> DataFrame:
    """Results of one round's removed nodes, from their solved parents (and, for spliced ones, child)."""
    above = solved.select(F.col("node").alias("of"), F.col("root").alias("top"), F.col("depth").alias("high"), F.col("path").alias("lead"), F.col("state").alias("above_state"))
    child = solved.select(F.col("node").alias("heir"), F.col("state").alias("kid_state"), F.col("folded").alias("kid_folded"))

    def finish(df: DataFrame, state: Column, folded: Column) -> DataFrame:
        tree = F.col("above_state") == TREE
        return df.select(
            "node",
            F.when(tree, F.col("top")).otherwise("").alias("root"),
            F.when(tree, F.col("high") + F.col("hops")).otherwise(-1).alias("depth"),
            F.when(tree, F.concat("lead", F.lit(separator), "seg")).otherwise("").alias("path"),
            state.alias("state"),
            folded.alias("folded"),
        )

    raked = records.filter(F.col("fate") == "rake").join(above, F.col("parent") == F.col("of"))
    spliced = records.filter(F.col("fate") == "splice").join(above, F.col("parent") == F.col("of")).join(child, F.col("kid") == F.col("heir")).withColumn("kid_all", how.two("kid_up", "kid_folded"))
    return finish(raked, F.when(F.col("above_state") == TREE, TREE).otherwise(BELOW), F.col("acc")).unionByName(
        finish(spliced, F.when(F.col("above_state") == TREE, TREE).when((F.col("above_state") == CYCLE) & (F.col("kid_state") == CYCLE), CYCLE).otherwise(BELOW), how.two("acc", "kid_all"))
    )


def clean_id(column: Column) -> Column:
    """An id as compared: white space around it, case and a leading `agent-` don't count."""
    white = "[\\s\\u00A0\\u200B\\u2060\\uFEFF]"
    blank = f"^{white}+|{white}+$"
    return F.regexp_replace(F.lower(F.regexp_replace(column, blank, "")), "^agent-", "")


def hierarchy(df: DataFrame, *, scope: str = "session_id", node: str = "agent_id", parent: str = "parent_agent_id", order: list[str] | None = None, limit: int = LIMIT) -> DataFrame:
    """Root, depth, path, state and number of descendants of each node within its scope.

    Ids are compared by `clean_id`. Of several rows of a node the one with the greatest `order` columns
    counts, whole (ties beyond them: the greatest parent id). A parent that is null, blank or without a row
    in the scope makes a root. Rows without scope or with a null or blank node id are no nodes. Columns:
    the scope, `node_id`, `root_id`, `tree_depth`, `safe_path` (ids with `%` and `/` as `%25` and `%2F`), `node_path`,
    `node_state`, `n_descendants` (null on or below a cycle); other columns don't matter.
    Scopes of more than `limit` bytes are contracted by distributed rounds, with 0 all of them.
    """
    order = order or ["captured_at", "record_id"]
    rows = df.select(F.col(scope).cast("string").alias("scope"), clean_id(F.col(node)).alias("id"), F.nullif(clean_id(F.col(parent)), F.lit("")).alias("above"), F.struct(*[F.col(c) for c in order]).alias("rank"))
    current = rows.filter(F.col("scope").isNotNull() & (F.col("id") != "")).groupBy("scope", "id").agg(F.max(F.struct("rank", "above")).alias("last")).select("scope", "id", F.col("last.above").alias("above"))
    if limit <= 0:
        out = _contract_large(cut_lineage(current, "current"))
    else:
        small, large = split_by_size(current, "scope", limit)
        out = map_scopes(small, "scope", _contract_table, "scope string, node_id string, root_id string, tree_depth int, safe_path string, node_state string, n_descendants bigint")
        if large is not None:
            out = out.unionByName(_contract_large(large))
    return out.select(F.col("scope").alias(scope), "node_id", "root_id", "tree_depth", "safe_path", _plain(F.col("safe_path")).alias("node_path"), "node_state", "n_descendants")


def _safe(column: Column) -> Column:
    return F.replace(F.replace(column, F.lit("%"), F.lit("%25")), F.lit("/"), F.lit("%2F"))


def _plain(column: Column) -> Column:
    return F.replace(F.replace(column, F.lit("%2F"), F.lit("/")), F.lit("%25"), F.lit("%"))


def _contract_table(table: pa.Table) -> Iterator[pa.Table]:
    """Tables of whole scopes contracted; results come in parts whose paths fit in memory, however deep the trees."""
    scope, ids = table.column("scope"), table.column("id")
    labels = np.array(ids.to_pylist(), object)
    safe = np.array([x.replace("%", "%25").replace("/", "%2F") for x in labels], object)
    forest = contract_arrays(positions(scope, ids, table.column("above")), label=safe, value=np.ones(table.num_rows), fold="sum")
    for part in forest.slices(PATH_CHARS):
        at, root = pa.array(part), forest.root[part]
        below = pa.array(forest.folded[part].astype(np.int64) - 1, mask=forest.state[part] != TREE_STATE)
        columns = [
            scope.take(at).cast(pa.string()), ids.take(at).cast(pa.string()), pa.array(np.where(root >= 0, labels[root], ""), pa.string()), pa.array(forest.depth[part].astype(np.int32)), pa.array(forest.paths(part), pa.string()),
            pa.array(STATES[forest.state[part]], pa.string()), below,
        ]
        yield pa.table(columns, names=["scope", "node_id", "root_id", "tree_depth", "safe_path", "node_state", "n_descendants"])


def _contract_large(current: DataFrame) -> DataFrame:
    key = lambda x: F.concat("scope", F.lit("\x1f"), x)
    keyed = cut_lineage(current.select(key("id").alias("node"), key("above").alias("wanted"), _safe(F.col("id")).alias("label")), "nodes")
    known = keyed.select(F.col("node").alias("parent"))
    nodes = keyed.join(known, F.col("wanted") == F.col("parent"), "left").select("node", "parent", "label", F.lit(1).alias("value"))
    part = lambda c, i: F.split(F.col(c), "\x1f", 2)[i]
    return contract(nodes, fold="sum").select(
        part("node", 0).alias("scope"), part("node", 1).alias("node_id"), F.when(F.col("root") == "", "").otherwise(part("root", 1)).alias("root_id"), F.col("depth").cast("int").alias("tree_depth"), F.col("path").alias("safe_path"),
        F.col("state").alias("node_state"), F.when(F.col("state") == TREE, F.col("folded") - 1).cast("bigint").alias("n_descendants"),
    )


def descendants(tree: DataFrame, *, scope: str = "session_id") -> DataFrame:
    """All pairs of a node and a node below it, with the distance, from the paths of `hierarchy`. Nodes on or
    below a cycle have none."""
    steps = F.split("safe_path", "/")
    up = F.posexplode(F.slice(steps, 1, F.greatest(F.size(steps) - 1, F.lit(0)))).alias("place", "ancestor_id")
    return tree.filter(F.col("node_state") == TREE).select(scope, "node_id", "tree_depth", up).select(scope, _plain(F.col("ancestor_id")).alias("ancestor_id"), F.col("node_id").alias("descendant_id"), (F.col("tree_depth") - F.col("place") - 1).alias("distance"))


def descendant_counts(tree: DataFrame, *, scope: str = "session_id") -> DataFrame:
    """Number of descendants of each tree node, as summed up by the contraction."""
    return tree.filter(F.col("node_state") == TREE).select(scope, "node_id", "tree_depth", "n_descendants")
