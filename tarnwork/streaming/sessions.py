"""Streams of session events: closing by idle gap, once-only delivery, status that only advances, hand-off.

Each function works on a batch and on a stream; `run_available` drives a stream over what is there, with its
state in the shared folder, so that a restarted run goes on where the last one ended.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwork.runtime import shared_folder

IDLE = "6 hours"
STATUSES = ["planning", "active", "concluded", "superseded"]


def close_sessions(events: DataFrame, *, key: str, at: str, gap: str = IDLE, late: str | None = None) -> DataFrame:
    """Sessions of each key: stretches without a pause of `gap`. With `late` a stream's watermark."""
    source = events.withWatermark(at, late) if late else events
    out = source.groupBy(F.session_window(at, gap).alias("w"), key).agg(F.count("*").alias("n_events"))
    return out.select(key, F.col("w.start").alias("started_at"), F.col("w.end").alias("closed_at"), "n_events")


def windowed_counts(events: DataFrame, *, at: str, width: str, by: str, late: str | None = None) -> DataFrame:
    """Events by fixed windows of time and a column."""
    source = events.withWatermark(at, late) if late else events
    return source.groupBy(F.window(at, width).alias("w"), by).agg(F.count("*").alias("n_events")).select(F.col("w.start").alias("window_start"), by, "n_events")


def once(events: DataFrame, key: list[str], *, at: str | None = None, late: str | None = None) -> DataFrame:
    """Rows of each key once: on a stream within the watermark, on a batch overall."""
    if events.isStreaming:
        return events.withWatermark(at, late).dropDuplicatesWithinWatermark(key)
    return events.dropDuplicates(key)


def status_rank(status: Column) -> Column:
    """Rank of a status; an unknown one is lowest."""
    return F.greatest(F.array_position(F.array(*map(F.lit, STATUSES)), F.coalesce(status, F.lit(""))).cast("int") - 1, F.lit(0))


def ratchet(events: DataFrame, *, key: str, status: str) -> DataFrame:
    """The furthest status of each key; it never goes back, whatever order events come in."""
    best = F.max(status_rank(F.col(status)))
    return events.groupBy(key).agg(F.element_at(F.array(*map(F.lit, STATUSES)), best + 1).alias("status"), F.count("*").alias("n_events"))


def ratchet_stream(events: DataFrame, *, key: str, status: str) -> DataFrame:
    """`ratchet` of a stream, with the greatest rank of each key kept as state across micro-batches; in update mode a batch
    gives one row for each key that it touched."""
    best = events.groupBy(F.col(key).cast("string").alias("key")).agg(F.max(status_rank(F.col(status))).alias("best"))
    return best.select("key", F.element_at(F.array(*map(F.lit, STATUSES)), F.col("best") + 1).alias("status"))


def conclude(notes: DataFrame, *, now: Column, hours: float = 24) -> DataFrame:
    """Notes with their next status: an active one that ended `hours` ago is concluded. Notes without a status
    are errors and stay."""
    stale = F.coalesce((F.unix_timestamp(now) - F.unix_timestamp("ended_at")) >= hours * 3600, F.lit(False))
    moved = F.when((F.col("session_status") == "active") & stale, "concluded").otherwise(F.col("session_status"))
    return notes.withColumn("next_status", moved).withColumn("problem", F.when(F.col("session_status").isNull(), "no status"))


def merge_fields(existing: DataFrame, new: DataFrame, key: str, kinds: dict[str, str], caps: dict[str, int] | None = None) -> DataFrame:
    """Two versions of notes field by field: lists are united (capped), `first` and `last` times and `count`s take
    the extreme, `keep` keeps the old value, other scalars take the new one unless it is empty."""
    caps = caps or {}
    old = existing.select(key, *[F.col(c).alias(f"old_{c}") for c in kinds])
    joined = new.join(old, key, "full_outer")

    def one(c: str, kind: str) -> Column:
        a, b = F.col(f"old_{c}"), F.col(c)
        if kind == "list":
            empty = F.array().cast("array<string>")
            return F.slice(F.array_union(F.coalesce(a, empty), F.coalesce(b, empty)), 1, caps.get(c, 1 << 30))
        if kind in ("first", "last", "count"):
            return F.least(a, b) if kind == "first" else F.greatest(a, b)
        if kind == "status":
            return F.element_at(F.array(*map(F.lit, STATUSES)), F.greatest(status_rank(a), status_rank(b)) + 1)
        filled = F.nullif(F.trim(a.cast("string")), F.lit("")) if kind == "keep" else F.nullif(F.trim(b.cast("string")), F.lit(""))
        return F.coalesce(filled, b if kind == "keep" else a)

    return joined.select(key, *[one(c, k).alias(c) for c, k in kinds.items()])


def inherit(children: DataFrame, parents: DataFrame, *, parent_key: str, fields: list[str]) -> DataFrame:
    """Children with the parent's value in fields that are empty."""
    up = parents.select(F.col(parent_key).alias("parent_key_of"), *[F.col(f).alias(f"up_{f}") for f in fields])
    joined = children.join(up, F.col(parent_key) == F.col("parent_key_of"), "left")
    for f in fields:
        joined = joined.withColumn(f, F.coalesce(F.nullif(F.trim(F.col(f)), F.lit("")), F.col(f"up_{f}")))
    return joined.drop("parent_key_of", *[f"up_{f}" for f in fields])


def first_copies(df: DataFrame, key: str, order: list[str], authors: list[str] | None = None) -> DataFrame:
    """The first copy of each key by allowed authors; copies are never merged."""
    rows = df if authors is None else df.filter(F.col("author").isin(authors))
    return rows.groupBy(key).agg(F.min_by(F.struct(*[c for c in df.columns if c != key]), F.struct(*order)).alias("x")).select(key, "x.*")


def hand_off(names: list[str], size: int = 80) -> list[list[str]]:
    """A list in runs of at most `size`."""
    return [names[i : i + size] for i in range(0, len(names), size)]


def run_available(stream: DataFrame, write: Callable[[DataFrame, int], None], *, mode: str = "update", name: str | None = None) -> None:
    """Run a stream over what its source holds now, handing each micro-batch to `write`."""
    place = f"{shared_folder(stream.sparkSession)}/stream-{name or uuid.uuid4().hex[:12]}"
    query = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", place).trigger(availableNow=True).start()
    query.awaitTermination()


def read_stream(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """A table's file or folder of files as a stream."""
    path = f"{directory}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    if target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(target).isDirectory():
        return spark.readStream.schema(schema).parquet(path)
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(directory)
