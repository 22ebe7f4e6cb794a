"""Rebuilding conversations from message rows.

Messages hang together by reply links. Connected components are found by alternating large-star and small-star
steps, all of them equi-joins and grouped minima; the components then decide which conversations are whole, and
the core's tree contraction gives each message its place and each branch its latest time. For conversations of
any size these are rounds of distributed jobs, none of which gathers a conversation's messages in one task;
conversations of at most `scoped.LIMIT` bytes go through the same steps on arrays, many at once in a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnwork.operators.forest import contract_arrays
from tarnwork.operators.hierarchy import contract
from tarnwork.operators.scoped import LIMIT, map_scopes, positions, split_by_size
from tarnwork.runtime import cut_lineage, cut_lineage_counting

#: Messages of one conversation that one task looks at together when neighbours are compared.
STRETCH = 10_000

_BLANK = "[\\s\\u0085\\u00A0\\u1680\\u180E\\u2000-\\u200D\\u2028\\u2029\\u202F\\u205F\\u2060\\u3000\\uFEFF]"

# Spellings of speakers.
_ROLES = {"human": "user", "ai": "assistant", "model": "assistant"}


def components(edges: DataFrame, *, max_rounds: int = 60) -> DataFrame:
    """Connected components of an undirected graph with string columns `u` and `v`: one row `node`,
    `component` (the least node) per node that has an edge to another. Loops and nulls don't count."""
    links = edges.filter("u IS NOT NULL AND v IS NOT NULL AND u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    mark = {"rows": F.count("*"), "mark": F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))}
    state, before = cut_lineage_counting(links, "edges", **mark)
    for _ in range(max_rounds):
        state, after = cut_lineage_counting(_small_star(_large_star(state)), "stars", **mark)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components not stable after {max_rounds} rounds")
    return state.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(state.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _large_star(edges: DataFrame) -> DataFrame:
    """Every greater neighbour of a node is linked to the node's least neighbour (or the node itself)."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy(F.col("u").alias("of")).agg(F.min("v").alias("m"))
    up = both.filter("v > u").join(least, F.col("u") == F.col("of")).select(F.col("v").alias("u"), F.least("m", "of").alias("v"))
    return up.filter("u != v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every lesser neighbour of a node, and the node, is linked to the least of them. Edges run downwards."""
    least = edges.groupBy(F.col("u").alias("of")).agg(F.min("v").alias("m"))
    down = edges.join(least, F.col("u") == F.col("of")).filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return down.unionByName(least.select(F.col("of").alias("u"), F.col("m").alias("v"))).distinct()


def speaker(role: Column, line_type: Column) -> Column:
    """`user`, `assistant`, `system` or another word, from however the row names its speaker."""
    said = F.lower(F.regexp_replace(F.coalesce(F.nullif(F.regexp_replace(role, f"{_BLANK}+", ""), F.lit("")), line_type), f"{_BLANK}+", ""))
    out = said
    for spelling, standard in _ROLES.items():
        out = F.when(said == spelling, standard).otherwise(out)
    return out


def is_blank(content: Column) -> Column:
    """Null, only white space, or a JSON list of blocks without any but text blocks of such text."""
    empty = lambda c: c.isNull() | c.rlike(f"^{_BLANK}*$")
    blocks = F.from_json(F.when(content.rlike(f"^{_BLANK}*\\["), content), "array<struct<type: string, text: string>>", {"mode": "PERMISSIVE"})
    only_blank = blocks.isNotNull() & F.forall(blocks, lambda b: (b["type"] == "text") & empty(b["text"]))
    return empty(content) | F.coalesce(only_blank, F.lit(False))


def messages(df: DataFrame) -> DataFrame:
    """One row per message: `scope`, `uuid`, `parent_uuid`, `role`, `ts`, `blank`. Of rows repeating a uuid the
    first one ingested counts. Rows without session or uuid are no messages."""
    # `ts` may be with or without zone; only its order matters.
    rows = df.filter("session_id IS NOT NULL AND uuid IS NOT NULL").select(
        F.col("session_id").cast("string").alias("scope"), F.col("uuid").cast("string").alias("uuid"), F.col("parent_uuid").cast("string").alias("parent_uuid"),
        speaker(F.col("msg_role"), F.col("line_type")).alias("role"), F.col("ts").cast("timestamp").cast("double").alias("ts"), is_blank(F.col("msg_content")).alias("blank"), "ingested_at", "line_id",
    )
    kept = F.min_by(F.struct("parent_uuid", "role", "ts", "blank"), F.struct("ingested_at", "line_id"))
    return rows.groupBy("scope", "uuid").agg(kept.alias("m")).select("scope", "uuid", "m.*")


def conversations(df: DataFrame, *, limit: int = LIMIT) -> DataFrame:
    """Kept conversations as ordered messages: `session_id`, `turn_no` (from 1), `uuid`, `msg_role`.

    A conversation is all rows of a session. It is whole when its messages form one component with exactly one
    null parent and no parent missing (then they are a tree). At a fork the branch with the latest time counts,
    of equal times the one with the least uuid; null times are earliest. Beside system messages a user's must
    come first, each be followed by an assistant's, and a user's and an assistant's not be blank. An empty
    table gives an empty result; a speaker of any other name breaks a conversation; extra columns don't matter.
    Conversations of more than `limit` bytes are treated by distributed rounds, with 0 all of them.
    """
    if limit <= 0:
        return _large_conversations(cut_lineage(messages(df), "messages"))
    small, large = split_by_size(messages(df), "scope", limit)
    out = map_scopes(small, "scope", _whole_scopes, "session_id string, turn_no int, uuid string, msg_role string")
    return out if large is None else out.unionByName(_large_conversations(large))


def star_components(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Least node of each node's component, by alternating large-star and small-star steps on arrays."""
    keep = a != b
    u, v = np.maximum(a, b)[keep], np.minimum(a, b)[keep]
    edges = np.unique(u * n + v)
    while True:
        u, v = edges // n, edges % n
        least = np.arange(n)
        np.minimum.at(least, u, v)  # of greater nodes the lesser neighbours, lesser nodes only know greater ones
        far, near = np.r_[u, v], np.r_[v, u]
        up = near > far
        hung = np.unique(near[up] * n + least[far[up]])
        hung = hung[hung // n != hung % n]
        u, v = hung // n, hung % n
        least = np.arange(n)
        np.minimum.at(least, u, v)
        root = least[u]
        down = v != root
        after = np.unique(np.r_[v[down] * n + root[down], u * n + root])
        after = after[after // n != after % n]
        if len(after) == len(edges) and (after == edges).all():
            break
        edges = after
    out = np.arange(n)
    out[edges // n] = edges % n
    return out


def _whole_scopes(table: pa.Table) -> Iterator[pa.Table]:
    """The kept conversations among whole small ones."""
    scope, uuid = table.column("scope"), table.column("uuid")
    n = table.num_rows
    ids = scope.to_pylist()
    code = np.cumsum([False, *(x != y for x, y in zip(ids, ids[1:]))]) if n else np.zeros(0, np.int64)
    scopes = int(code[-1]) + 1 if n else 0
    per = lambda flags: np.bincount(code, weights=flags, minlength=scopes)
    parent = positions(scope, uuid, table.column("parent_uuid"))
    opens = table.column("parent_uuid").is_null().to_numpy()
    linked = parent >= 0
    component = star_components(np.flatnonzero(linked), parent[linked], n)
    whole = (per(component == np.arange(n)) == 1) & (per(opens) == 1) & (per(~linked) == 1)

    ts = table.column("ts").fill_null(-np.inf).to_numpy().astype(np.float64)
    names = np.array(uuid.to_pylist(), object)
    forest = contract_arrays(np.where(whole[code], parent, -1), value=ts)
    # The best child of every fork: latest branch, then least uuid.
    inner = np.flatnonzero(linked & whole[code])
    inner = inner[np.lexsort((names[inner].astype(str), -forest.folded[inner], parent[inner]))]
    first = np.r_[True, parent[inner][1:] != parent[inner][:-1]] if len(inner) else np.zeros(0, bool)
    follows = np.full(n, -1, np.int64)
    follows[inner[first]] = parent[inner[first]]
    runs = contract_arrays(follows)
    on_chain = whole[code] & (runs.root == forest.root)
    turn = runs.depth

    roles = np.array(table.column("role").to_pylist(), object)
    blank = table.column("blank").to_numpy()
    spoken = np.flatnonzero(on_chain & (roles != "system"))
    spoken = spoken[np.lexsort((turn[spoken], code[spoken]))]
    role, at = roles[spoken], code[spoken]
    user, reply = role == "user", role == "assistant"
    begins = np.r_[True, at[1:] != at[:-1]] if len(at) else np.zeros(0, bool)
    answered = np.r_[~begins[1:] & reply[1:], False] if len(at) else begins
    count = lambda flags: np.bincount(at, weights=flags, minlength=scopes)
    faults = count(begins & ~user) + count(user & ~answered) + count(~(user | reply))
    good = (faults == 0) & (count(user & ~blank[spoken]) > 0) & (count(reply & ~blank[spoken]) > 0)
    out = np.flatnonzero(on_chain & good[code]) if n else spoken
    columns = [scope.take(pa.array(out)).cast(pa.string()), pa.array(turn[out].astype(np.int32)), uuid.take(pa.array(out)).cast(pa.string()), pa.array(roles[out], pa.string())]
    yield pa.table(columns, names=["session_id", "turn_no", "uuid", "msg_role"])


def _large_conversations(parts: DataFrame) -> DataFrame:
    key = lambda c: F.concat("scope", F.lit("\x1f"), c)
    all_messages = parts.select("scope", "uuid", key("uuid").alias("node"), key("parent_uuid").alias("wanted"), "role", "ts", "blank")
    known = all_messages.select(F.col("node").alias("parent"))
    linked = all_messages.join(known, F.col("wanted") == F.col("parent"), "left")
    found = components(linked.filter("parent IS NOT NULL").select(F.col("node").alias("u"), F.col("parent").alias("v")))
    labelled = cut_lineage(linked.join(found.withColumnRenamed("node", "member"), F.col("node") == F.col("member"), "left").select("scope", "node", "uuid", "parent", F.col("wanted").isNull().alias("opens"), "role", "ts", "blank", F.coalesce("component", "node").alias("component")), "labelled")

    per_component = labelled.groupBy("scope", "component").agg(F.count_if("opens").alias("openers"), F.count_if(F.col("parent").isNull()).alias("roots"))
    whole = per_component.groupBy("scope").agg(F.count("*").alias("components"), F.sum("openers").alias("openers"), F.sum("roots").alias("roots")).filter("components = 1 AND openers = 1 AND roots = 1").select(F.col("scope").alias("kept"))
    trees = cut_lineage(labelled.join(whole, F.col("scope") == F.col("kept"), "left_semi").drop("component", "opens"), "trees")

    order = F.struct(F.coalesce("ts", F.lit(float("-inf"))).alias("ts"))
    placed = contract(trees.select("node", "parent", order.alias("value")), paths=False, fold="max")
    with_place = cut_lineage(trees.join(placed.withColumnRenamed("node", "at"), F.col("node") == F.col("at")).select("scope", "node", "uuid", "parent", "role", "blank", "root", "depth", F.col("folded.ts").alias("latest")), "placed")
    chain = _chain(with_place)
    return _validated(chain).select(F.col("scope").alias("session_id"), F.col("turn_no").cast("int").alias("turn_no"), "uuid", F.col("role").alias("msg_role"))


def _chain(placed: DataFrame) -> DataFrame:
    """Messages from the root on, at each fork into the branch with the latest time."""
    best = placed.filter("parent IS NOT NULL").groupBy(F.col("parent").alias("fork")).agg(F.min_by("node", F.struct(-F.col("latest"), F.col("uuid"))).alias("heir"), F.count("*").alias("branches"))
    best = cut_lineage(best, "heirs")
    forked = best.filter("branches > 1").join(placed.select("node", "scope"), F.col("fork") == F.col("node")).select(F.col("scope").alias("forked")).distinct()
    plain = placed.join(forked, F.col("scope") == F.col("forked"), "left_anti").withColumn("turn_no", F.col("depth"))
    split = cut_lineage(placed.join(forked, F.col("scope") == F.col("forked"), "left_semi"), "forked")
    follows = split.join(best.select("heir", "fork"), F.col("node") == F.col("heir"), "left").select("node", F.col("fork").alias("parent"))
    runs = contract(follows, paths=False).select(F.col("node").alias("at"), F.col("root").alias("run"), F.col("depth").alias("turn_no"))
    main = split.join(runs, (F.col("node") == F.col("at")) & (F.col("root") == F.col("run")))
    columns = ["scope", "uuid", "role", "blank", "turn_no"]
    return cut_lineage(plain.select(*columns).unionByName(main.select(*columns)), "chain")


def _validated(chain: DataFrame) -> DataFrame:
    """The chains whose speakers take turns. Neighbours are compared within stretches of a conversation, and
    the ends of stretches among themselves."""
    spoken = chain.filter("role IS NULL OR role != 'system'").withColumn("stretch", F.floor(F.col("turn_no") / STRETCH))
    within = Window.partitionBy("scope", "stretch").orderBy("turn_no")
    answered = spoken.withColumn("next_role", F.lead("role").over(within)).withColumn("final", F.lead(F.lit(True)).over(within).isNull())
    ends = answered.groupBy("scope", "stretch").agg(
        F.min_by("role", "turn_no").alias("first_role"),
        F.max_by("role", "turn_no").alias("last_role"),
        F.count_if((F.col("role") == "user") & ~F.col("final") & ~F.coalesce(F.col("next_role") == "assistant", F.lit(False))).alias("unanswered"),
        F.count_if(~F.coalesce(F.col("role").isin("user", "assistant"), F.lit(False))).alias("strange"),
        F.count_if((F.col("role") == "user") & ~F.col("blank")).alias("asked"),
        F.count_if((F.col("role") == "assistant") & ~F.col("blank")).alias("told"),
    )
    joints = ends.withColumn("next_first", F.lead("first_role").over(Window.partitionBy("scope").orderBy("stretch")))
    open_end = (F.col("last_role") == "user") & ~F.coalesce(F.col("next_first") == "assistant", F.lit(False))
    good = joints.groupBy("scope").agg(F.min_by("first_role", "stretch").alias("opener"), F.sum("unanswered").alias("unanswered"), F.count_if(open_end).alias("open_ends"), F.sum("strange").alias("strange"), F.sum("asked").alias("asked"), F.sum("told").alias("told"))
    kept = good.filter("opener = 'user' AND unanswered = 0 AND open_ends = 0 AND strange = 0 AND asked > 0 AND told > 0").select(F.col("scope").alias("good"))
    return chain.join(kept, F.col("scope") == F.col("good"), "left_semi")
