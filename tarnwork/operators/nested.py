"""Deeply nested JSON columns as flat, linked rows.

One row per object that is an element of an array, at any depth, found by the structural index of
`functions.json_index`. Rows know their path, the nearest enclosing such object, their type and the name
under which other rows refer to them, so that parents and answers are linked by plain equi-joins.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwork.functions.json_index import ARR, OBJ, STRING, JsonIndex, index
from tarnwork.runtime import arrow_map, cut_lineage

ROW = pa.schema([("row_id", pa.int64()), ("item_path", pa.string()), ("parent_path", pa.string()), ("item_type", pa.string()), ("own_id", pa.string()), ("answers_id", pa.string())])


def unwrap_twice_encoded(texts: pa.Array) -> pa.Array:
    """Texts that are one JSON string come out as that string's content, all others unchanged."""
    starts = pc.fill_null(pc.starts_with(pc.utf8_ltrim(texts, " \t\r\n"), '"'), False)
    where = np.flatnonzero(starts.to_numpy(zero_copy_only=False))
    if not len(where):
        return texts
    outer = texts.take(pa.array(where))
    ix = index(outer)
    single = np.flatnonzero((ix.lev == 0) & (ix.cls == STRING))
    inner = np.full(len(texts), None, object)
    inner[where[ix.doc[single]]] = ix.texts(single)
    return pc.if_else(starts, pa.array(inner, pa.large_string()), texts.cast(pa.large_string()))


def elements(ix: JsonIndex, column: str) -> dict[str, np.ndarray | list[str]]:
    """The array-element objects of an index: `doc`, `item_path`, `parent_path`, `item_type`, `own_id`, `answers_id`."""
    opens = np.flatnonzero((ix.cls == OBJ) | (ix.cls == ARR))
    within = np.where(ix.parent >= 0, ix.cls[ix.parent], -1)
    element = np.zeros(len(ix.pos), bool)
    element[opens] = (ix.cls[opens] == OBJ) & (within[opens] == ARR)
    names, named = ix.coded(np.maximum(ix.key[opens], 0)[ix.key[opens] >= 0])
    label = np.zeros(len(ix.pos), np.int64)
    in_array = opens[within[opens] == ARR]
    label[in_array] = ix.place[in_array] + len(named)
    label[opens[ix.key[opens] >= 0]] = names

    # A path is a number into `paths`; each level makes only its distinct pairs of parent path and step.
    paths, at = [column], np.zeros(len(ix.pos), np.int64)
    nearest = np.full(len(ix.pos), -1, np.int64)
    for level in range(1, int(ix.lev[opens].max(initial=0)) + 1):
        here = opens[ix.lev[opens] == level]
        up = ix.parent[here]
        nearest[here] = np.where(element[up], up, nearest[up])
        width = int(label[here].max(initial=0)) + 1
        pairs, back = np.unique(at[up] * width + label[here], return_inverse=True)
        at[here] = back + len(paths)
        for pair in pairs.tolist():
            head, step = divmod(pair, width)
            paths.append(f"{paths[head]}.{named[step]}" if step < len(named) else f"{paths[head]}[{step - len(named)}]")

    chosen = np.flatnonzero(element)
    values = ix.member(["type", "id", "tool_use_id"])

    def text(name: str, missing: str | None) -> pa.Array:
        token = values[name][chosen]
        have = (token >= 0) & (ix.cls[np.maximum(token, 0)] == STRING)
        ids, distinct = ix.coded(token[have])
        codes = np.full(len(chosen), len(distinct), np.int64)
        codes[have] = ids
        return pa.array([*distinct, missing], pa.string()).take(pa.array(codes))

    table = pa.array(paths, pa.string())
    enclosing = np.where(nearest[chosen] >= 0, at[np.maximum(nearest[chosen], 0)], len(paths))
    return {
        "doc": ix.doc[chosen],
        "item_path": table.take(pa.array(at[chosen])),
        "parent_path": pa.array([*paths, ""], pa.string()).take(pa.array(enclosing)),
        "item_type": text("type", ""),
        "own_id": text("id", None),
        "answers_id": text("tool_use_id", None),
    }


def array_objects(df: DataFrame, *, id_column: str, columns: list[str], twice_encoded: list[str] | None = None) -> DataFrame:
    """One row per object that is an element of an array in any of the JSON `columns`.

    Columns: `row_id` (of `id_column`), `item_path` (column name, then `.key` and `[index]` steps),
    `parent_path` (path of the nearest enclosing such object, or `''`), `item_type` (its `type`, `''` when
    that is no string), `own_id` and `answers_id` (its `id` and `tool_use_id`, null when no string).
    Null, empty and invalid texts give no rows; a text of `twice_encoded` columns that is one JSON string is
    read as that string's content. Repeated rows give repeated results, of a repeated member name the last
    counts for `type` and ids, and other columns of `df`, whatever their names, don't matter.
    """
    twice = set(twice_encoded or [])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, column in enumerate(columns):
                texts = batch.column(k + 1)
                found = elements(index(unwrap_twice_encoded(texts) if column in twice else texts), column)
                rows = batch.column(0).take(pa.array(found.pop("doc")))
                yield pa.RecordBatch.from_arrays([rows, *found.values()], schema=ROW)

    picked = df.select(F.col(id_column).cast("bigint").alias("row_id"), *[F.col(c).cast("string").alias(f"text_{k}") for k, c in enumerate(columns)])
    return arrow_map(picked, scan, "row_id bigint, item_path string, parent_path string, item_type string, own_id string, answers_id string")


def unnest(df: DataFrame, *, id_column: str, columns: list[str], twice_encoded: list[str] | None = None, call_type: str = "tool_use", answer_type: str = "tool_result") -> DataFrame:
    """`array_objects` with `use_row_id`: for an object of `answer_type`, the lowest row with an object of
    `call_type` whose `id` equals its `tool_use_id`; 0 without such a row and for all other types.

    The index runs once; its narrow result is written, then joined with its own calls. Calls are reduced to
    one row per id before the join, so a hot id only makes one side long, which adaptive execution splits.
    """
    rows = cut_lineage(array_objects(df, id_column=id_column, columns=columns, twice_encoded=twice_encoded), "objects")
    calls = rows.filter((F.col("item_type") == call_type) & F.col("own_id").isNotNull()).groupBy(F.col("own_id").alias("call_id")).agg(F.min("row_id").alias("call_row"))
    answers = F.when(F.col("item_type") == answer_type, F.col("answers_id"))
    linked = rows.filter(answers.isNotNull()).join(calls, F.col("answers_id") == F.col("call_id"), "left")
    shape = ["row_id", "item_path", "parent_path", "item_type"]
    return linked.select(*shape, F.coalesce("call_row", F.lit(0)).alias("use_row_id")).unionByName(rows.filter(answers.isNull()).select(*shape, F.lit(0).cast("bigint").alias("use_row_id")))
