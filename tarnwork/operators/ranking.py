"""Row numbers and running sums within groups of any size.

A plain window puts a whole group into one task, which a hot group outgrows. Here rows are range-partitioned by
group and order, numbered within their slice, and lifted by what the group's earlier slices hold; only those
few sums per group and slice are ordered by a window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnwork.runtime import cut_lineage


def number_rows(df: DataFrame, *, group: list[str], order: list[str | Column], place: str = "place", sums: dict[str, str] | None = None) -> DataFrame:
    """`df` with `place` (from 1 in `order`) and, for each of `sums`, the running sum of a column up to the row.
    The order should be total; null groups are one group. Rows are written once, so that slices stay what they
    are when they are read twice."""
    sums = sums or {}
    sliced = cut_lineage(df.repartitionByRange(*group, *order).withColumn("slice_no", F.spark_partition_id()), "sliced")
    inner = Window.partitionBy(*group, "slice_no").orderBy(*order)
    running = inner.rowsBetween(Window.unboundedPreceding, 0)
    local = sliced.withColumn(place, F.row_number().over(inner))
    for name, column in sums.items():
        local = local.withColumn(name, F.sum(column).over(running))
    totals = sliced.groupBy(*group, "slice_no").agg(F.count("*").alias("rows_of"), *[F.sum(c).alias(f"sum_{n}") for n, c in sums.items()])
    ahead = Window.partitionBy(*group).orderBy("slice_no")
    before = totals.select(*[F.col(g).alias(f"of_{g}") for g in group], F.col("slice_no").alias("of_slice"), (F.sum("rows_of").over(ahead) - F.col("rows_of")).alias("rows_before"), *[(F.sum(f"sum_{n}").over(ahead) - F.col(f"sum_{n}")).alias(f"before_{n}") for n in sums])
    same = F.col("slice_no") == F.col("of_slice")
    for g in group:
        same = same & F.col(g).eqNullSafe(F.col(f"of_{g}"))
    lifted = local.join(before, same).withColumn(place, (F.col(place) + F.col("rows_before")).cast("bigint"))
    for name in sums:
        lifted = lifted.withColumn(name, F.col(name) + F.col(f"before_{name}"))
    return lifted.drop("slice_no", "of_slice", "rows_before", *[f"of_{g}" for g in group], *[f"before_{n}" for n in sums])
