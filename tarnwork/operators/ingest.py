"""What an ingest run does to each document, which rows are orphans, and the merges that follow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnwork.functions.text import WHITE
from tarnwork.operators.ranking import number_rows

ACTIONS = ["inserted", "updated", "metadata-updated", "unchanged", "failed"]


def blank_as_null(value: Column) -> Column:
    return F.nullif(F.trim(value), F.lit(""))


def claim_duplicates(files: DataFrame, *, key: str = "external_id", order: str = "path") -> DataFrame:
    """Files with the path that owns their key (the first in order) and whether this one is it."""
    owners = files.groupBy(F.col(key).alias("key_of")).agg(F.min(order).alias("owner_path"))
    return files.join(owners, F.col(key) == F.col("key_of")).drop("key_of").withColumn("is_owner", F.col(order) == F.col("owner_path"))


def first_rows(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key, by a struct minimum that is combined before the shuffle."""
    rest = [c for c in df.columns if c not in key]
    return df.groupBy(*key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("kept")).select(*key, "kept.*")


def stripped(text: Column) -> Column:
    """Text without white space of any kind at its ends; empty for null."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), rf"^[{WHITE}]+|[{WHITE}]+\z", "")


def skip_reason(text: Column, *, least: int = 80) -> Column:
    """Why a record isn't loaded: `empty`, `short` (under `least` characters), or null."""
    return F.when(stripped(text) == "", "empty").when(F.length(stripped(text)) < least, "short")


def plan_actions(incoming: DataFrame, stored: DataFrame, *, forced: bool = False, dry_run: bool = False) -> DataFrame:
    """The action for every incoming document.

    Both sides: `source, external_id, content_hash, title, collection, metadata` (canonical JSON);
    `incoming` also `n_chunks`. Same hash: `unchanged`, or `metadata-updated` when title, collection or metadata
    differ (blank is null). Else `inserted` or `updated`; without chunks `failed`. A dry run says `would-...`.
    """
    key = ["source", "external_id"]
    old = stored.select(*key, *[F.col(c).alias(f"old_{c}") for c in ("content_hash", "title", "collection", "metadata")])
    differs = F.lit(False)
    for c in ("title", "collection", "metadata"):
        differs = differs | ~blank_as_null(F.col(c)).eqNullSafe(blank_as_null(F.col(f"old_{c}")))
    same = F.col("old_content_hash").eqNullSafe(F.col("content_hash")) & F.lit(not forced)
    written = F.when(F.coalesce("n_chunks", F.lit(0)) == 0, "failed").when(F.col("old_content_hash").isNull(), "inserted").otherwise("updated")
    action = F.when(same & differs, "metadata-updated").when(same, "unchanged").otherwise(written)
    if dry_run:
        would = {"inserted": "would-insert", "updated": "would-update", "metadata-updated": "would-update-metadata"}
        for done, planned in would.items():
            action = F.when(action == done, planned).otherwise(action)
    return incoming.join(old, key, "left").withColumn("action", action).drop(*[f"old_{c}" for c in ("content_hash", "title", "collection", "metadata")])


def run_stats(planned: DataFrame) -> DataFrame:
    """Documents and chunks by action, actions without documents included."""
    spine = planned.sparkSession.createDataFrame([(a,) for a in ACTIONS], "action string")
    counts = planned.groupBy("action").agg(F.count("*").alias("n"), F.sum("n_chunks").alias("m"))
    return spine.join(counts, "action", "left").select("action", F.coalesce("n", F.lit(0)).alias("n_documents"), F.coalesce("m", F.lit(0)).alias("n_chunks"))


def merge_documents(stored: DataFrame, planned: DataFrame, columns: list[str]) -> DataFrame:
    """The store after a run: planned rows replace stored ones of the same key, `updated_at` is set where
    something was written, all other rows are kept."""
    key = ["source", "external_id"]
    new = planned.filter(F.col("action").isin("inserted", "updated", "metadata-updated")).select(*key, F.lit(True).alias("is_new"), *[F.col(c).alias(f"new_{c}") for c in columns], F.col("at").alias("new_at"))
    joined = stored.join(new, key, "full_outer")
    pick = lambda c: F.when(F.col("is_new"), F.col(f"new_{c}")).otherwise(F.col(c)).alias(c)
    return joined.select(*key, *[pick(c) for c in columns], F.when(F.col("is_new"), F.col("new_at")).otherwise(F.col("updated_at")).alias("updated_at"))


def orphans(stored: DataFrame, seen: DataFrame, *, written_before: Column) -> DataFrame:
    """Stored keys that the walk didn't see, with `spared` for rows written at or after its start."""
    gone = stored.join(seen.select("source", "external_id"), ["source", "external_id"], "left_anti")
    return gone.withColumn("spared", ~F.coalesce(F.col("updated_at") < written_before, F.lit(False)))


def may_prune(*, limited: bool, failures: int, documents: int) -> bool:
    """Whether a run saw enough to call anything an orphan."""
    return not limited and failures == 0 and documents > 0


def insert_if_absent(stored: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Rows of `new` whose key isn't stored, once each; null keys are equal to each other."""
    fresh = new.dropDuplicates(key)
    return fresh.join(stored.select(*[F.col(k).alias(f"had_{k}") for k in key]).distinct(), _equal(key), "left_anti")


def _equal(key: list[str]) -> Column:
    out = F.lit(True)
    for k in key:
        out = out & F.col(k).eqNullSafe(F.col(f"had_{k}"))
    return out


def latest_rows(df: DataFrame, key: list[str], value: str, order: str) -> DataFrame:
    """The value of each key's latest row."""
    return df.groupBy(*key).agg(F.max_by(value, order).alias(value))


def append_if_changed(decisions: DataFrame, new: DataFrame, key: list[str], value: str, order: str) -> DataFrame:
    """Rows of `new` whose value differs from the latest stored one of their key."""
    last = latest_rows(decisions, key, value, order).withColumnRenamed(value, "last_value").withColumn("had", F.lit(True))
    return new.join(last, key, "left").filter(F.col("had").isNull() | ~F.col(value).eqNullSafe(F.col("last_value"))).drop("last_value", "had")


def allocate(existing: DataFrame, new: DataFrame, *, group: str, order: list[str], prefix: str = "ISSUE") -> DataFrame:
    """New rows with the next sequence numbers of their group and ids `<prefix>-<group>-NNN`."""
    top = existing.groupBy(group).agg(F.max("seq").alias("top"))
    numbered = number_rows(new, group=[group], order=order).join(top, group, "left").withColumn("seq", F.coalesce("top", F.lit(0)) + F.col("place"))
    return numbered.drop("place", "top").withColumn("issue_id", F.concat(F.lit(f"{prefix}-"), F.col(group), F.lit("-"), F.lpad(F.col("seq").cast("string"), 3, "0")))


def replace_by_key(stored: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Stored rows of all other keys, and all new ones."""
    return stored.join(new.select(*key).distinct(), key, "left_anti").unionByName(new)


def heal_events(expected: DataFrame, stored: DataFrame, key: list[str]) -> DataFrame:
    """Keys whose stored number of event rows isn't the expected one."""
    a = expected.groupBy(*key).agg(F.count("*").alias("expected"))
    b = stored.groupBy(*key).agg(F.count("*").alias("found"))
    both = a.join(b, key, "full_outer").select(*key, F.coalesce("expected", F.lit(0)).alias("expected"), F.coalesce("found", F.lit(0)).alias("found"))
    return both.filter("expected != found")
