"""Provenance reports: what every search returned, counted over retrieval events.

An event row is one result of one search, or one row with null `rank` for a search without results. A search is
the triple of note, session and index; `RETRIEVAL` names it.
"""

from __future__ import annotations

import html
import re
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RETRIEVAL = ["note_external_id", "session_id", "retrieval_index"]
BUCKETS = [round(0.5 + 0.05 * k, 2) for k in range(10)]


def since_bound(value: str | None, now: datetime) -> datetime | None:
    """A time bound: ISO date, ISO time (without zone it is UTC) or `<N>d`; None for None."""
    if value is None:
        return None
    if m := re.fullmatch(r"(\d+)d", value.strip()):
        return now - timedelta(days=int(m[1]))
    try:
        out = datetime.fromisoformat(value.strip())
    except ValueError:
        raise ValueError(f"not a date, a time or <N>d: {value!r}") from None
    return out if out.tzinfo else out.replace(tzinfo=timezone.utc)


def retrieval_key() -> Column:
    """The search that an event row belongs to; nulls are values of their own."""
    return F.struct(*[F.col(c) for c in RETRIEVAL])


def with_documents(events: DataFrame, documents: DataFrame) -> DataFrame:
    """Events with title and collection of the document hit, null where it isn't stored."""
    docs = documents.select(F.col("source").alias("d_source"), F.col("external_id").alias("d_external_id"), F.col("title").alias("hit_title"), F.col("collection").alias("hit_collection"))
    return events.join(docs, (F.col("source") == F.col("d_source")) & (F.col("external_id") == F.col("d_external_id")), "left").drop("d_source", "d_external_id")


def totals(events: DataFrame) -> DataFrame:
    """Rows, searches, sessions and the span of time."""
    return events.agg(F.count("*").alias("n_rows"), F.count_distinct(retrieval_key()).alias("n_retrievals"), F.count_distinct("session_id").alias("n_sessions"), F.min("retrieved_at").alias("first_at"), F.max("retrieved_at").alias("last_at"))


def most_retrieved(events: DataFrame, *, limit: int = 20) -> DataFrame:
    """Documents by number of results, then of sessions, then by key."""
    hits = events.filter("rank IS NOT NULL").groupBy("source", "external_id").agg(F.count("*").alias("n_results"), F.count_distinct("session_id").alias("n_sessions"))
    return hits.orderBy(F.desc("n_results"), F.desc("n_sessions"), "source", "external_id").limit(limit)


def never_retrieved(events: DataFrame, documents: DataFrame) -> DataFrame:
    """Documents that no event names."""
    return documents.join(events.filter("rank IS NOT NULL").select("source", "external_id"), ["source", "external_id"], "left_anti")


def never_retrieved_counts(events: DataFrame, documents: DataFrame) -> DataFrame:
    """Documents never retrieved, by collection."""
    return never_retrieved(events, documents).groupBy(F.coalesce("collection", F.lit("(none)")).alias("collection")).agg(F.count("*").alias("n_documents"))


def empty_queries(events: DataFrame, *, limit: int = 20) -> DataFrame:
    """Searches without results, newest first."""
    return events.filter("rank IS NULL").select("retrieved_at", *RETRIEVAL).orderBy(F.desc("retrieved_at"), *RETRIEVAL).limit(limit)


def _bucket(similarity: Column) -> Column:
    step = F.floor(F.round(similarity * 20, 9))
    top = F.least(step, F.lit(19)) * 5
    return F.when(similarity.isNull(), "n/a").when(step < 10, "<0.50").otherwise(F.format_string("%d.%02d", F.lit(0), top.cast("int")))


def similarity_histogram(events: DataFrame) -> DataFrame:
    """Results by similarity in steps of 0.05 from 0.50, empty steps included, with their share."""
    names = ["<0.50", *[f"{b:.2f}" for b in BUCKETS], "n/a"]
    spine = events.sparkSession.createDataFrame([(b,) for b in names], "bucket string")
    counts = events.filter("rank IS NOT NULL").groupBy(_bucket(F.col("similarity")).alias("bucket")).agg(F.count("*").alias("n"))
    filled = spine.join(counts, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).alias("n_results"))
    total = F.sum("n_results").over(Window.partitionBy(F.lit(0)))  # over the dozen rows of the spine
    return filled.withColumn("total", total).select("bucket", "n_results", F.round(F.when(F.col("total") > 0, F.col("n_results") / F.col("total")).otherwise(0.0), 6).alias("share"))


def similarity_summary(events: DataFrame) -> DataFrame:
    """Least, middle and greatest similarity of the results."""
    held = events.filter("rank IS NOT NULL AND similarity IS NOT NULL").select("similarity")
    low, high = held.agg(F.min("similarity"), F.max("similarity")).first()
    values = [None if v is None else round(v, 6) for v in (low, exact_median(held, "similarity"), high)]
    return events.sparkSession.createDataFrame([tuple(values)], "least double, middle double, greatest double")


def exact_median(df: DataFrame, column: str, *, few: int = 10_000, buckets: int = 1024) -> float | None:
    """The median of a column without nulls. Rows are counted by buckets between the least and the greatest value, and again
    within the bucket that holds the middle, until it has `few` distinct values: never more of them reach one place."""

    def at(rows: DataFrame, rank: int) -> float:
        while True:
            low, high, distinct = rows.agg(F.min(column), F.max(column), F.approx_count_distinct(column)).first()
            if low == high:
                return low
            if distinct <= few:
                for value, n in rows.groupBy(column).agg(F.count("*").alias("n")).orderBy(column).collect():
                    if rank < n:
                        return value
                    rank -= n
            bucket = F.least(F.floor((F.col(column) - low) / (high - low) * buckets), F.lit(buckets - 1))
            for k, n in rows.groupBy(bucket.alias("k")).agg(F.count("*").alias("n")).orderBy("k").collect():
                if rank < n:
                    rows = rows.filter(bucket == k)
                    break
                rank -= n

    n = df.count()
    if not n:
        return None
    first = at(df, (n - 1) // 2)
    return first if n % 2 else (first + at(df, n // 2)) / 2


def per_collection(events: DataFrame, channels: list[str]) -> DataFrame:
    """Searches, results, empty searches and sessions by the collection searched from, and searches by channel."""
    by = F.coalesce("collection", F.lit("(none)")).alias("collection")
    empty = F.when(F.col("rank").isNull(), retrieval_key())
    pivot = [F.count_distinct(F.when(F.col("channel") == c, retrieval_key())).alias(f"via_{c}") for c in channels]
    return events.groupBy(by).agg(F.count_distinct(retrieval_key()).alias("n_retrievals"), F.count("rank").alias("n_results"), F.count_distinct(empty).alias("n_empty"), F.count_distinct("session_id").alias("n_sessions"), *pivot)


def cross_collection(events: DataFrame) -> DataFrame:
    """Searches whose filter names another collection than the one they came from, once each."""
    named = F.get_json_object("filters", "$.collection")
    return events.withColumn("asked", named).filter(F.col("asked").isNotNull() & ~F.col("asked").eqNullSafe(F.col("collection"))).groupBy(*RETRIEVAL).agg(F.min("collection").alias("own_collection"), F.min("asked").alias("asked_collection"))


def retrieval_counts(events: DataFrame) -> DataFrame:
    """Distinct searches that returned a document, and those whose result was used."""
    used = F.when(F.col("used"), retrieval_key())
    return events.filter("rank IS NOT NULL").groupBy("source", "external_id").agg(F.count_distinct(retrieval_key()).alias("n_retrievals"), F.count_distinct(used).alias("n_used"))


def resolve_results(events: DataFrame, documents: DataFrame) -> DataFrame:
    """Events with the id of the document that each result names, null where it isn't stored."""
    keys = documents.select("source", "external_id", F.col("document_id").alias("result_document_id"))
    return events.join(keys, ["source", "external_id"], "left")


def parse_retrievals(notes: DataFrame) -> DataFrame:
    """Event rows from notes' lists of searches.

    `notes`: `note_external_id, session_id` and `retrievals`, an array of `at, tool, query, results
    array<string>`. A result reads `source:external_id@similarity` (first colon, last `@`, both parts needed;
    without a number behind it the `@` belongs to the id). Ranks count from 1 in the list; a search without
    results gives one row of null rank; a malformed result is dropped; without session id nothing is kept.
    """
    entries = notes.filter("session_id IS NOT NULL AND session_id != ''").select("note_external_id", "session_id", F.posexplode("retrievals").alias("retrieval_index", "entry"))
    rows = entries.select("note_external_id", "session_id", "retrieval_index", F.col("entry.at").alias("retrieved_at"), F.col("entry.tool").alias("tool"), F.col("entry.query").alias("query"), F.posexplode_outer("entry.results").alias("place", "token"))
    parsed = [x.alias(n) for n, x in token_parts(F.col("token")).items()]
    ranked = rows.select("note_external_id", "session_id", "retrieval_index", "retrieved_at", "tool", "query", (F.col("place") + 1).alias("rank"), "token", *parsed)
    return ranked.filter("token IS NULL OR source IS NOT NULL").drop("token")


def token_parts(token: Column) -> dict[str, Column]:
    """Source, external id and similarity of a result token; all null when malformed."""
    number = r"@(-?(?:\d+\.?\d*|\.\d+))$"
    body = F.regexp_replace(token, number, "")
    good = body.rlike(r"^[^:]+:.+$")
    similarity = F.nullif(F.regexp_extract(token, number, 1), F.lit("")).try_cast("double")
    return {"source": F.when(good, F.regexp_extract(body, r"^([^:]+):", 1)), "external_id": F.when(good, F.regexp_extract(body, r"^[^:]+:(.+)$", 1)), "similarity": F.when(good, similarity)}


def dashboard(report: dict[str, list[dict]], *, generated_at: datetime) -> str:
    """One HTML page of small report tables; only `generated_at` changes between runs on the same data."""
    parts = [f"<!doctype html><meta charset='utf-8'><title>Retrieval report</title><p>Generated {html.escape(generated_at.isoformat())}</p>"]
    for title, rows in report.items():
        parts.append(f"<h2>{html.escape(title)}</h2>")
        if not rows:
            parts.append("<p>none</p>")
            continue
        head = "".join(f"<th>{html.escape(str(c))}</th>" for c in rows[0])
        body = "".join("<tr>" + "".join(f"<td>{'' if v is None else html.escape(str(v))}</td>" for v in row.values()) + "</tr>" for row in rows)
        parts.append(f"<table><tr>{head}</tr>{body}</table>")
    return "\n".join(parts)
