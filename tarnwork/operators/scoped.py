"""Work on whole scopes (sessions and the like) of bounded size, many at a time, inside one task.

Rows are hashed by scope and sorted within their partition; the function sees runs of whole scopes as one Arrow
table, so that it can be vectorised over them. Only scopes of at most `limit` bytes may come this way: callers
split larger ones off with `split_by_size` and treat them with distributed steps.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnwork.runtime import arrow_map, cut_lineage_counting

#: Estimated bytes of one scope's rows that a task may hold together.
LIMIT = 16 << 20
#: Bytes that a row's numbers, states and object headers take beside its texts.
ROW_BYTES = 200


def row_bytes(df: DataFrame) -> Column:
    """What a row takes in a task: its texts twice (as held and as worked on) and its numbers."""
    out = F.lit(ROW_BYTES).cast("bigint")
    for field in df.schema:
        if field.dataType == T.StringType():
            out = out + 2 * F.coalesce(F.octet_length(field.name), F.lit(0))
    return out


def split_by_size(df: DataFrame, scope: str, limit: int = LIMIT) -> tuple[DataFrame, DataFrame | None]:
    """`df` written, as its rows of scopes with at most `limit` bytes and those of larger ones (None if there
    are none)."""
    sizes = df.groupBy(F.col(scope).alias("scope_of")).agg(F.sum(row_bytes(df)).alias("scope_bytes")).filter(F.col("scope_bytes") > limit)
    flagged = df.join(sizes, F.col(scope) == F.col("scope_of"), "left").withColumn("is_large", F.col("scope_of").isNotNull()).drop("scope_of", "scope_bytes")
    written, seen = cut_lineage_counting(flagged, "scopes", large=F.count_if("is_large"))
    small = written.filter("NOT is_large").drop("is_large")
    return small, written.filter("is_large").drop("is_large") if seen["large"] else None


def map_scopes(df: DataFrame, scope: str, function: Callable[[pa.Table], Iterator[pa.Table]], schema: str) -> DataFrame:
    """The tables that `function` makes of tables of whole scopes, `scope` being the first column that it sees."""
    ordered = df.select(scope, *[c for c in df.columns if c != scope]).repartition(F.col(scope)).sortWithinPartitions(scope)

    def made(table: pa.Table) -> Iterator[pa.RecordBatch]:
        for part in function(table.combine_chunks()):
            yield from part.to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            ids = held.column(0)
            if held.num_rows < 4096 or ids[0].as_py() == ids[-1].as_py():
                continue
            cut = pc.index(ids, ids[-1]).as_py()  # sorted: the last scope may go on
            yield from made(held.slice(0, cut))
            held = held.slice(cut)
        if held is not None and held.num_rows:
            yield from made(held)

    return arrow_map(ordered, run, schema)


def positions(scope: pa.ChunkedArray, key: pa.ChunkedArray, wanted: pa.ChunkedArray) -> np.ndarray:
    """Row number of `wanted` among the `key`s of the same scope; -1 where null or absent."""
    join = lambda a, b: pc.binary_join_element_wise(a.cast(pa.large_string()), b.cast(pa.large_string()), pa.scalar("\x1f", pa.large_string()))
    values = join(scope, key)
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    return pc.fill_null(pc.index_in(join(scope, wanted), value_set=values), -1).to_numpy().astype(np.int64)
