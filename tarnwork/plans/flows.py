"""Queries on chunking, transcript scans and session streams."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwork.functions.markdown import block_rows, chunk_documents
from tarnwork.runtime import shared_folder, ship, table
from tarnwork.sources.exports import pair_tool_calls, tool_counts
from tarnwork.streaming import sessions


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")


def _statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    status = F.when(kind == "signup", "planning").when(kind == "click", "active").when((kind == "purchase") & (F.col("user_id") % 2 == 0), "concluded").when((kind == "error") & (F.col("user_id") % 5 == 0), "superseded").otherwise("unknown")
    return _events(spark, sf_dir).select("user_id", status.alias("status"))


def stream_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly counts by type from the event stream; the last state of every window, written by the run."""
    ship(spark)
    place = f"{shared_folder(spark)}/counts-{uuid.uuid4().hex[:12]}"
    counted = sessions.windowed_counts(sessions.read_stream(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")), at="ts", width="1 hour", by="event_type", late="2 days")

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(place)

    sessions.run_available(counted, write, mode="complete")
    return spark.read.parquet(place).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


def stream_ratchet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Furthest status of every user from the event stream, by stateful steps."""
    ship(spark)
    place = f"{shared_folder(spark)}/ratchet-{uuid.uuid4().hex[:12]}"
    kind = F.col("event_type")
    status = F.when(kind == "signup", "planning").when(kind == "click", "active").when(kind == "purchase", "concluded").otherwise("unknown")
    source = sessions.read_stream(spark, sf_dir, "events").select("user_id", status.alias("status"))

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch_no", F.lit(number)).write.mode("append").parquet(place)

    sessions.run_available(sessions.ratchet_stream(source, key="user_id", status="status"), write, mode="update")
    # The last row that the stream gave for a key is its state.
    return spark.read.parquet(place).groupBy("key").agg(F.max_by("status", "batch_no").alias("status"))


def conclude(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "sessions").select("session_id", "captured_at", "session_status", "ended_at")
    return sessions.conclude(rows, now=F.lit("2026-07-01 00:00:00").cast("timestamp_ntz")).select("session_id", "captured_at", "next_status", "problem")


def merge_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated session rows merged field by field: earliest and latest row of each."""
    rows = table(spark, sf_dir, "sessions").select("session_id", "collection_key", "started_at", "ended_at", "prompt_count", "captured_at")
    first = sessions.first_copies(rows, "session_id", ["captured_at", "prompt_count"])
    last = rows.groupBy("session_id").agg(F.max_by(F.struct("collection_key", "started_at", "ended_at", "prompt_count"), F.struct("captured_at", "prompt_count")).alias("x")).select("session_id", "x.*")
    return sessions.merge_fields(first, last, "session_id", {"collection_key": "scalar", "started_at": "first", "ended_at": "last", "prompt_count": "count"})


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "chunk_documents": lambda s, d: chunk_documents(table(s, d, "documents"), key="doc_id", body="text", title="title"),
    "markdown_blocks": lambda s, d: block_rows(table(s, d, "documents"), key="doc_id", body="text").groupBy("kind").agg(F.count("*").alias("n_blocks")),
    "tool_call_pairs": lambda s, d: pair_tool_calls(table(s, d, "transcript_lines")),
    "tool_counts": lambda s, d: tool_counts(table(s, d, "transcript_lines")),
    "session_close": lambda s, d: sessions.close_sessions(_events(s, d), key="user_id", at="ts").select("user_id", "started_at", "n_events"),
    "windowed_counts": lambda s, d: sessions.windowed_counts(_events(s, d), at="ts", width="1 hour", by="event_type"),
    "deliver_once": lambda s, d: sessions.once(table(s, d, "transcript_lines").select("uuid"), ["uuid"]),
    "status_ratchet": lambda s, d: sessions.ratchet(_statuses(s, d), key="user_id", status="status"),
    "conclude_sweep": conclude,
    "merge_sessions": merge_sessions,
    "stream_counts": stream_counts,
    "stream_ratchet": stream_ratchet,
}

_HOURS = "SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n_events FROM events GROUP BY 1, 2"

ORACLES: dict[str, str] = {
    "session_close": """WITH g AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL OR ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) > INTERVAL 6 HOUR THEN 1 ELSE 0 END AS opens FROM events),
  n AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS no FROM g) SELECT user_id, min(ts) AS started_at, count(*) AS n_events FROM n GROUP BY user_id, no""",
    "windowed_counts": _HOURS,
    "stream_counts": _HOURS,
    "deliver_once": "SELECT DISTINCT uuid FROM transcript_lines",
    "status_ratchet": """WITH s AS (SELECT user_id, CASE WHEN event_type = 'click' THEN 1 WHEN event_type = 'purchase' AND user_id % 2 = 0 THEN 2 WHEN event_type = 'error' AND user_id % 5 = 0 THEN 3 ELSE 0 END AS r FROM events)
SELECT user_id, ['planning', 'active', 'concluded', 'superseded'][max(r) + 1] AS status, count(*) AS n_events FROM s GROUP BY 1""",
    "stream_ratchet": "WITH s AS (SELECT user_id, CASE event_type WHEN 'click' THEN 1 WHEN 'purchase' THEN 2 ELSE 0 END AS r FROM events) SELECT CAST(user_id AS VARCHAR) AS key, ['planning', 'active', 'concluded'][max(r) + 1] AS status FROM s GROUP BY 1",
    "conclude_sweep": "SELECT session_id, captured_at, CASE WHEN session_status = 'active' AND coalesce(epoch_us(TIMESTAMP '2026-07-01') // 1000000 - epoch_us(ended_at) // 1000000 >= 86400, false) THEN 'concluded' ELSE session_status END AS next_status, CASE WHEN session_status IS NULL THEN 'no status' END AS problem FROM sessions",
    "merge_sessions": """WITH a AS (SELECT session_id, arg_min(struct_pack(c := collection_key, s := started_at, e := ended_at, n := prompt_count), struct_pack(x := captured_at, y := prompt_count)) AS o, arg_max(struct_pack(c := collection_key, s := started_at, e := ended_at, n := prompt_count), struct_pack(x := captured_at, y := prompt_count)) AS w FROM sessions GROUP BY 1)
SELECT session_id, coalesce(nullif(trim(w.c), ''), o.c) AS collection_key, least(o.s, w.s) AS started_at, greatest(o.e, w.e) AS ended_at, greatest(o.n, w.n) AS prompt_count FROM a""",
    "tool_call_pairs": """WITH b AS (SELECT line_id, unnest(from_json(json_extract(message, '$.content'), '[{"type":"VARCHAR","id":"VARCHAR","name":"VARCHAR","tool_use_id":"VARCHAR"}]')) AS b FROM transcript_lines WHERE json_valid(message) AND json_type(message, '$.content') = 'ARRAY'),
  c AS (SELECT b.id AS call_id, min(line_id) AS call_line, min(b.name) AS tool FROM b WHERE b.type = 'tool_use' AND b.id IS NOT NULL GROUP BY 1), a AS (SELECT b.tool_use_id AS call_id, min(line_id) AS answer_line FROM b WHERE b.type = 'tool_result' AND b.tool_use_id IS NOT NULL GROUP BY 1)
SELECT call_id, call_line, tool, answer_line FROM c LEFT JOIN a USING (call_id)""",
    "tool_counts": """SELECT b.name AS tool, count(*) AS n_calls FROM (SELECT unnest(from_json(json_extract(message, '$.content'), '[{"type":"VARCHAR","name":"VARCHAR"}]')) AS b FROM transcript_lines WHERE json_valid(message) AND json_type(message, '$.content') = 'ARRAY') WHERE b.type = 'tool_use' AND b.name IS NOT NULL GROUP BY 1""",
}
