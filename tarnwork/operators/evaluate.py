"""Scoring of retrieval against golden cases: hit@k, mean reciprocal rank, negatives."""

from __future__ import annotations

import json
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_hits(cases: DataFrame, hits: DataFrame) -> DataFrame:
    """Per case the rank of the first expected hit, null without one.

    `cases`: `case_id, realm, collection, expect array<string>, expect_contains array<string>, negative`;
    `hits`: `case_id, rank, external_id, title, content`. A hit is expected when its id is in `expect` or its
    title or content holds a text of `expect_contains`, case aside.
    """
    body = F.lower(F.concat_ws("\n", "title", "content"))
    expected = F.coalesce(F.array_contains("expect", F.col("external_id")), F.lit(False)) | F.coalesce(F.exists("expect_contains", lambda x: F.contains(body, F.lower(x))), F.lit(False))
    joined = cases.join(hits, "case_id", "left")
    return joined.groupBy("case_id", "realm", "collection", "negative").agg(F.min(F.when(expected, F.col("rank"))).alias("first_rank"), F.count("rank").alias("n_hits"))


def scores(found: DataFrame, *, k: int = 3) -> DataFrame:
    """hit@k and reciprocal rank over positive cases, and the share of negative ones without any hit; a group
    without cases scores 1."""
    positive, negative = ~F.col("negative"), F.col("negative")
    hit = F.when(positive, F.coalesce((F.col("first_rank") <= k).cast("double"), F.lit(0.0)))
    reciprocal = F.when(positive, F.coalesce(1.0 / F.col("first_rank"), F.lit(0.0)))
    silent = F.when(negative, (F.col("n_hits") == 0).cast("double"))
    return found.agg(*[F.round(F.coalesce(F.avg(c), F.lit(1.0)), 6).alias(n) for n, c in (("hit_rate", hit), ("mrr", reciprocal), ("negative_pass_rate", silent))])


def by_collection(found: DataFrame, *, k: int = 3) -> DataFrame:
    """Positive cases' scores by realm (`-` without one) and collection."""
    positive = found.filter(~F.col("negative"))
    hit = F.coalesce((F.col("first_rank") <= k).cast("double"), F.lit(0.0))
    return positive.groupBy(F.coalesce("realm", F.lit("-")).alias("realm"), F.coalesce("collection", F.lit("-")).alias("collection")).agg(F.count("*").alias("n_cases"), F.round(F.avg(hit), 6).alias("hit_rate"), F.round(F.avg(F.coalesce(1.0 / F.col("first_rank"), F.lit(0.0))), 6).alias("mrr"))


def append_history(report: dict, path: str, *, at: datetime) -> None:
    """Add one JSON line to a local history file."""
    with open(path, "a", encoding="utf-8") as out:
        out.write(json.dumps({"at": at.isoformat(), **report}, sort_keys=True) + "\n")


def embedder_parity(references: DataFrame, produced: DataFrame, *, threshold: float = 0.999) -> DataFrame:
    """Worst cosine between stored and produced vectors of the same text (`text, vector` each), and whether it
    reaches the threshold; a text without a produced vector counts as 0."""
    from tarnwork.functions.vector import cosine

    pair = references.join(produced.withColumnRenamed("vector", "made"), "text", "left")
    value = F.coalesce(cosine(F.col("vector"), F.col("made")), F.lit(0.0))
    return pair.agg(F.round(F.min(value), 6).alias("worst"), F.min_by("text", value).alias("worst_text"), (F.min(value) >= threshold).alias("passed"))
