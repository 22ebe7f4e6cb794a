"""Filling fixed-capacity containers with texts by vector best-fit.

A container has three capacities: tokens, documents and attention cost (the sum of squared lengths). An
item's demand in all three follows from its length, so the corpus is, for the purpose of packing, a histogram
over at most `capacity` lengths. Best-fit-decreasing runs on that histogram: containers in the same state are
one group, and a step moves as many of a length's items as the chosen group has containers. Its cost depends
on the number of lengths, not on the corpus. Every item then finds its container by its rank among the items
of its length, which is taken in hashed buckets, so that a length held by a third of all rows is no hot group.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import isqrt

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarnwork.llm.tokens import DEFAULT_RANKS, token_counts
from tarnwork.runtime import cut_lineage

CAPACITY = 2048
BUCKET_ROWS = 200_000
BROADCAST_STEPS = 100_000


@dataclass(frozen=True)
class Capacities:
    """What a container holds; without `documents` and `attention` only tokens bind. `score` chooses among containers:
    the least weighted `norm` of what remains, or the greatest weighted `dot` product of demand and room."""

    tokens: int = CAPACITY
    documents: int | None = None
    attention: int | None = None
    weights: tuple[float, float, float] = (1.0, 0.01, 0.01)
    score: str = "norm"

    @property
    def largest(self) -> int:
        """Tokens of the largest item that fits an empty container."""
        return self.tokens if self.attention is None else min(self.tokens, isqrt(self.attention))


def plan(histogram: dict[int, int], capacities: Capacities) -> list[tuple[int, int, int, int, int, int]]:
    """Steps `(length, first rank, number, first container, place, offset)`: items of `length` with ranks from
    `first rank` on go one each to consecutive containers, at `place` (from 1) and token `offset`.

    Longest lengths first. Among the groups that an item fits in every capacity the best one has the smallest
    weighted norm of what remains (`score='norm'`) or the greatest weighted dot product of demand and residual
    (`'dot'`); ties go to the least room in tokens. Residuals count only as far as they can still matter: no
    container takes more documents than tokens, nor more attention than its tokens squared.
    """
    top = np.array([capacities.tokens, capacities.documents or capacities.tokens, capacities.attention or capacities.tokens**2], np.float64)
    weights = np.array(capacities.weights)
    # A group is a state (tokens, documents and attention left) and its runs of containers (first, number, placed).
    states: dict[tuple[int, int, int], list[list[int]]] = {}
    table, live = np.zeros((0, 3)), []
    steps, containers = [], 0

    def real(state: tuple[int, int, int]) -> tuple[int, int, int]:
        tokens, documents, attention = state
        return tokens, min(documents, tokens), min(attention, tokens * tokens)

    def put(state: tuple[int, int, int], first: int, number: int, placed: int) -> None:
        nonlocal table
        state = real(state)
        if min(state) <= 0:
            return
        if state not in states:
            states[state] = []
            live.append(state)
            table = np.vstack([table, np.array(state, np.float64)])
        runs = states[state]
        if runs and runs[-1][0] + runs[-1][1] == first and runs[-1][2] == placed:
            runs[-1][1] += number
        else:
            runs.append([first, number, placed])

    for length in sorted((n for n, k in histogram.items() if k > 0), reverse=True):
        demand = np.array([length, 1, length * length], np.float64)
        left, rank = histogram[length], 0
        while left:
            fits = (table >= demand).all(1) if len(table) else np.zeros(0, bool)
            if fits.any():
                at = np.flatnonzero(fits)
                after = (table[at] - demand) / top
                value = np.sqrt((weights * after**2).sum(1)) if capacities.score == "norm" else -(weights * (demand / top) * (table[at] / top)).sum(1)
                chosen = at[np.lexsort((table[at, 0], np.round(value, 12)))[0]]
                state = live[chosen]
                runs = states[state]
                first, number, placed = runs[-1]
                moved = min(number, left)
                runs[-1] = [first + moved, number - moved, placed]
                if not runs[-1][1]:
                    runs.pop()
                if not runs:
                    del states[state], live[chosen]
                    table = np.delete(table, chosen, 0)
                steps.append((length, rank, moved, first, placed + 1, capacities.tokens - state[0]))
                put((state[0] - length, state[1] - 1, state[2] - length * length), first, moved, placed + 1)
                rank, left = rank + moved, left - moved
                continue
            if (demand > top).any():
                raise ValueError(f"no container takes an item of {length} tokens")
            fill = int((top // demand).min())
            number = max(1, left // fill)
            used = min(left, fill)
            for k in range(used):
                steps.append((length, rank, number, containers, k + 1, k * length))
                rank += number
            left -= used * number
            put(tuple(int(t - used * d) for t, d in zip(top, demand)), containers, number, used)
            containers += number
    return steps


def pack(df: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", capacities: Capacities | None = None, ranks_path: str = DEFAULT_RANKS) -> DataFrame:
    """Container and place of every non-empty text, or of its pieces where it exceeds the capacity.

    Columns `doc_id`, `piece_no` (0 for a whole text, else from 1), `start_token`, `n_tokens`, `container_id`,
    `place` (from 1) and `container_offset` (first token's position). Only texts above the capacity (in tokens or, by
    the square of their length, in attention) are split: into full pieces and a rest. Null and empty texts have no row; repeated rows are items of their own.
    """
    capacities = capacities or Capacities()
    size = capacities.largest
    counts = token_counts(df, id_column=id_column, text_column=text_column, ranks_path=ranks_path).filter("n_tokens > 0")
    pieces = F.when(F.col("n_tokens") <= size, F.array(F.lit(0))).otherwise(F.sequence(F.lit(1), F.ceil(F.col("n_tokens") / size).cast("int")))
    start = (F.greatest("piece_no", F.lit(1)) - 1).cast("bigint") * size
    items = counts.select("doc_id", "n_tokens", F.explode(pieces).alias("piece_no")).select("doc_id", "piece_no", start.alias("start_token"), F.least(F.col("n_tokens") - start, F.lit(size)).cast("int").alias("size"))
    items = cut_lineage(items, "items")

    histogram = {r["size"]: r["n"] for r in items.groupBy("size").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    steps = plan(histogram, capacities)
    buckets = max(16, max(histogram.values(), default=0) // BUCKET_ROWS)

    bucketed = items.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece_no"), F.lit(buckets)).cast("int"))
    per_bucket = bucketed.groupBy("size", "bucket").agg(F.count("*").alias("n"))
    before = per_bucket.select("size", "bucket", (F.sum("n").over(Window.partitionBy("size").orderBy("bucket")) - F.col("n")).alias("base"))
    inner = F.row_number().over(Window.partitionBy("size", "bucket").orderBy("doc_id", "piece_no")) - 1
    ranked = bucketed.withColumn("inner_rank", inner).join(before, ["size", "bucket"]).select("doc_id", "piece_no", "start_token", "size", (F.col("base") + F.col("inner_rank")).alias("rank"))

    spark = df.sparkSession
    chosen = spark.createDataFrame(steps, "length int, first_rank bigint, number bigint, first_container bigint, place int, container_offset int")
    if len(steps) <= BROADCAST_STEPS:
        chosen = F.broadcast(chosen)
    inside = (F.col("size") == F.col("length")) & (F.col("rank") >= F.col("first_rank")) & (F.col("rank") < F.col("first_rank") + F.col("number"))
    return ranked.join(chosen, inside).select("doc_id", "piece_no", "start_token", F.col("size").alias("n_tokens"), (F.col("first_container") + F.col("rank") - F.col("first_rank")).alias("container_id"), "place", "container_offset")


def checks(packed: DataFrame, counts: DataFrame, capacities: Capacities) -> DataFrame:
    """One row that says how a packing keeps its promises: `n_texts` and `n_tokens` packed, `lost_tokens` (of the texts'
    tokens), `repeated_places`, containers `over_tokens`, `over_documents` and `over_attention`, pieces with a `wrong_offset`,
    and whether the containers are `within_bound`: at most a quarter more than the fullest capacity needs, and one."""
    wide = F.col("n_tokens").cast("bigint")
    per = packed.groupBy("container_id").agg(F.sum(wide).alias("tokens"), F.count("*").alias("documents"), F.sum(wide * wide).alias("attention"), (F.count("*") - F.count_distinct("place")).alias("repeated"), F.max(F.col("container_offset") + F.col("n_tokens")).alias("reach"))
    top = [capacities.tokens, capacities.documents or capacities.tokens, capacities.attention or capacities.tokens**2]
    need = [F.ceil(F.sum(c) / F.lit(t)) for c, t in zip(("tokens", "documents", "attention"), top)]
    held = per.agg(
        F.coalesce(F.sum("tokens"), F.lit(0)).alias("n_tokens"), F.coalesce(F.sum("repeated"), F.lit(0)).alias("repeated_places"), *[F.count_if(F.col(c) > t).alias(f"over_{c}") for c, t in zip(("tokens", "documents", "attention"), top)],
        F.count_if(F.col("reach") != F.col("tokens")).alias("wrong_offset"), (F.count("*") <= F.greatest(*need) * 1.25 + 1).alias("within_bound"),
    )
    texts = counts.filter("n_tokens > 0").agg(F.count("*").alias("n_texts"), F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("all_tokens"))
    one = F.lit(1).alias("one")
    return held.select("*", one).join(texts.select("*", one), "one").select("n_texts", (F.col("all_tokens") - F.col("n_tokens")).alias("lost_tokens"), "repeated_places", "over_tokens", "over_documents", "over_attention", "wrong_offset", "within_bound")
