"""Audits of a document store: each check returns finding rows (`check_name, document_id, detail`)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnwork.functions.lexical import WORD
from tarnwork.functions.vector import cosine, norm

ORDER = ["chunk index", "norm", "tokens", "vault", "drift"]


def heuristic_tokens(text: Column, chars: int = 6) -> Column:
    """One token per started `chars` characters of a word and per other character that is no white space."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    others = F.length(F.regexp_replace(text, r"(?U)[\p{L}\p{N}_\s]", ""))
    return F.aggregate(words, F.lit(0).cast("bigint"), lambda s, w: s + F.ceil(F.length(w) / chars)) + others


def _finding(name: str, detail: Column, document: str = "document_id") -> list[Column]:
    return [F.lit(name).alias("check_name"), F.col(document).cast("string").alias("document_id"), detail.alias("detail")]


def chunk_indexes(chunks: DataFrame) -> DataFrame:
    """Documents whose chunk indexes aren't exactly 0 to n-1: how many chunks, duplicates, the least and the greatest
    index. Only counts and extremes are shuffled; `chunk_index_faults` gives the indexes themselves."""
    per = chunks.groupBy("document_id").agg(F.count("*").alias("n"), F.count_distinct("chunk_index").alias("distinct_n"), F.min("chunk_index").alias("low"), F.max("chunk_index").alias("high"))
    bad = per.filter("n != distinct_n OR low != 0 OR high != n - 1")
    detail = F.concat(F.lit("n="), "n", F.lit(" duplicate="), F.col("n") - F.col("distinct_n"), F.lit(" low="), "low", F.lit(" high="), "high")
    return bad.select(*_finding("chunk index", detail))


def chunk_index_faults(chunks: DataFrame, documents: DataFrame | None = None) -> DataFrame:
    """One row per faulty index of a document: `duplicate`, `out of range`, or the first of each run that is `missing`
    (`until` is its last). With `documents` those without any chunk come out as `childless`. Indexes are compared with
    their neighbours by joins, so no document's chunks are gathered; only the ends of runs are numbered."""
    held = chunks.groupBy("document_id", "chunk_index").agg(F.count("*").alias("times"))
    size = held.groupBy("document_id").agg(F.sum("times").alias("n"))
    placed = held.join(size, "document_id")
    row = lambda df, fault, at, until: df.select("document_id", F.lit(fault).alias("fault"), at.cast("bigint").alias("chunk_index"), until.cast("bigint").alias("until"))
    index = F.col("chunk_index")
    outside = index.isNull() | (index < 0) | (index >= F.col("n"))
    inside = placed.filter(~outside).select("document_id", "n", index.cast("bigint").alias("chunk_index"))
    with_ends = lambda at: inside.unionByName(size.select("document_id", "n", at.cast("bigint").alias("chunk_index")))
    other = lambda step: inside.select(F.col("document_id").alias("of"), (index + step).alias("beside"))
    beside = (F.col("document_id") == F.col("of")) & (index == F.col("beside"))
    # A run is missing between an index without successor and the next one without predecessor; these come in turn.
    order = F.row_number().over(Window.partitionBy("document_id").orderBy("chunk_index"))
    before = with_ends(F.lit(-1)).filter("chunk_index < n - 1").join(other(-1), beside, "left_anti").select(F.col("document_id").alias("of"), F.col("chunk_index").alias("lower"), order.alias("run"))
    behind = with_ends(F.col("n")).filter("chunk_index > 0").join(other(1), beside, "left_anti").select("document_id", "chunk_index", order.alias("turn"))
    gaps = behind.join(before, (F.col("document_id") == F.col("of")) & (F.col("turn") == F.col("run")))
    missing = row(gaps, "missing", F.col("lower") + 1, index - 1)
    out = row(placed.filter(outside), "out of range", index, index).unionByName(row(placed.filter("times > 1"), "duplicate", index, index)).unionByName(missing)
    if documents is not None:
        none = F.lit(None)
        out = out.unionByName(row(documents.select("document_id").join(size.select("document_id"), "document_id", "left_anti"), "childless", none, none))
    return out


def norms(chunks: DataFrame, tolerance: float = 1e-3) -> DataFrame:
    """Chunks without vector, or whose vector isn't of unit length. Only the length leaves the scan."""
    length = F.round(norm(F.col("embedding")), 6)
    return chunks.select("document_id", "chunk_id", length.alias("length")).filter(F.col("length").isNull() | (F.abs(F.col("length") - 1) > tolerance)).select(*_finding("norm", F.concat("chunk_id", F.lit(" "), F.coalesce(F.col("length").cast("string"), F.lit("none")))))


def token_counts(chunks: DataFrame, *, window: int = 512, drift: float = 0.10) -> DataFrame:
    """Chunks above the model's window, or whose stored count is off by more than `drift`."""
    counted = chunks.select("document_id", "chunk_id", "token_count", heuristic_tokens(F.col("content")).alias("counted"))
    off = F.abs(F.col("token_count") - F.col("counted")) > drift * F.greatest("counted", F.lit(1))
    return counted.filter((F.col("counted") > window) | off).select(*_finding("tokens", F.concat_ws(" ", "chunk_id", "token_count", "counted")))


def vault(notes: DataFrame, stored: DataFrame, *, fresh_since: Column | None = None) -> DataFrame:
    """Notes against stored rows (`external_id, content_hash`, stored also `updated_at`): missing, differing
    and orphaned. Rows updated at or after `fresh_since` are no orphans."""
    a, b = notes.select("external_id", F.col("content_hash").alias("note_hash")), stored.select("external_id", F.col("content_hash").alias("row_hash"), "updated_at")
    both = a.join(b, "external_id", "full_outer")
    orphan = F.col("note_hash").isNull()
    if fresh_since is not None:
        orphan = orphan & (F.col("updated_at") < fresh_since)
    detail = F.when(F.col("row_hash").isNull(), "missing").when(orphan, "orphan").when(F.col("note_hash") != F.col("row_hash"), "differs")
    return both.withColumn("detail", detail).filter("detail IS NOT NULL").select(*_finding("vault", F.col("detail"), "external_id"))


def drift(chunks: DataFrame, made: DataFrame, *, threshold: float = 0.999) -> DataFrame:
    """Chunks whose stored vector is no longer what the embedder makes (`chunk_id, vector`)."""
    value = cosine(F.col("embedding"), F.col("vector"))
    return chunks.join(made, "chunk_id").withColumn("value", F.round(value, 6)).filter(~F.coalesce(F.col("value") >= threshold, F.lit(False))).select(*_finding("drift", F.concat_ws(" ", "chunk_id", F.col("value").cast("decimal(9,6)").cast("string"))))


def sample(df: DataFrame, key: str, size: int, seed: int) -> DataFrame:
    """`size` rows chosen by a seeded hash of their key, the same on every run; all when there are fewer."""
    return df.orderBy(F.xxhash64(F.col(key), F.lit(seed)), key).limit(size)


def run_audit(*findings: DataFrame) -> DataFrame:
    """All findings, in the order of the checks."""
    out = findings[0]
    for more in findings[1:]:
        out = out.unionByName(more)
    rank = F.array_position(F.array(*map(F.lit, ORDER)), F.col("check_name"))
    return out.withColumn("check_order", rank).orderBy("check_order", "document_id", "detail")
