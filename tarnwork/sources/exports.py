"""JSON exports (observations, summaries, prompts with a session dimension), material rows, transcripts."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarnwork.functions.jsonq import string_list
from tarnwork.functions.text import collection_for_course, file_slug, truncate

SHORT_PROMPT = 80
# Prose columns of a summary and their headings.
SECTIONS = [("request", "Request"), ("investigated", "Investigated"), ("learned", "Learned"), ("completed", "Completed"), ("next_steps", "Next steps"), ("notes", "Notes")]


def _clean(name: str) -> Column:
    return F.nullif(F.trim(F.col(name)), F.lit(""))


def _rows(spark: SparkSession, path: Path, schema: str) -> DataFrame:
    """Rows of a JSON list or of JSON lines, with exactly the columns of `schema`."""
    if not path.exists():
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("multiLine", "true").json(path.as_uri())


def render_sections(sections: list[tuple[str, str]]) -> Column:
    """Non-blank columns as markdown sections; empty without any."""
    return F.concat_ws("\n\n", *[F.when(_clean(c).isNotNull(), F.concat(F.lit(f"## {heading}\n\n"), _clean(c))) for c, heading in sections])


def load_export(spark: SparkSession, folder: str, *, include_summaries: bool = True, include_prompts: bool = True) -> DataFrame:
    """Documents of an export folder: `source, external_id, collection, title, body, metadata, skip_reason`."""
    root = Path(folder)
    if not root.is_dir():
        raise ValueError(f"no such export folder: {folder}")
    sessions = _rows(spark, root / "sessions.json", "id bigint, content_session_id string, memory_session_id string, project string, status string, custom_title string")
    first = lambda key: sessions.filter(f"{key} IS NOT NULL").withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy("id"))).filter("place = 1").select(F.col(key).alias("session_key"), F.to_json(F.struct("project", "status", "custom_title")).alias("session"))
    by_memory, by_content = first("memory_session_id"), first("content_session_id")

    seen = _rows(spark, root / "observations.json", "id bigint, memory_session_id string, project string, text string, type string, title string, subtitle string, facts string, narrative string, concepts string, files_read string, files_modified string, prompt_number int, discovery_tokens int, created_at string, content_hash string")
    body = F.coalesce(_clean("narrative"), _clean("text"))
    fields = [F.lit("observation").alias("record_type"), "type", "project", "memory_session_id", "subtitle", "prompt_number", "discovery_tokens", "created_at", F.col("content_hash").alias("source_content_hash"), *[string_list(F.col(c)).alias(c) for c in ("facts", "concepts", "files_read", "files_modified")]]
    out = _documents(seen, F.col("id").cast("string"), body, F.coalesce(_clean("title"), F.concat(F.lit("Observation "), "id")), fields, F.when(body.isNull(), "empty observation"), "memory_session_id", by_memory)

    if include_summaries:
        sums = _rows(spark, root / "summaries.json", "id bigint, memory_session_id string, project string, request string, investigated string, learned string, completed string, next_steps string, notes string, files_read string, files_edited string, prompt_number int, discovery_tokens int, created_at string")
        text = render_sections(SECTIONS)
        key = F.concat(F.lit("summary:"), "id")
        title = F.concat(F.lit("["), F.coalesce(_clean("project"), F.lit("unknown")), F.lit("] "), F.coalesce(truncate(_clean("request"), 120), F.concat(F.lit("Session summary "), key)))
        fields = [F.lit("session_summary").alias("record_type"), "project", "memory_session_id", "prompt_number", "discovery_tokens", "created_at", string_list(F.col("files_read")).alias("files_read"), string_list(F.col("files_edited")).alias("files_edited")]
        out = out.unionByName(_documents(sums, key, F.nullif(text, F.lit("")), title, fields, F.when(text == "", "empty summary"), "memory_session_id", by_memory))
    if include_prompts:
        asked = _rows(spark, root / "prompts.json", "id bigint, content_session_id string, prompt_number int, prompt_text string, created_at string")
        text = _clean("prompt_text")
        reason = F.when(text.isNull(), "empty prompt").when(F.length(text) < SHORT_PROMPT, "short prompt")
        fields = [F.lit("user_prompt").alias("record_type"), "content_session_id", "prompt_number", "created_at"]
        out = out.unionByName(_documents(asked, F.concat(F.lit("prompt:"), "id"), text, truncate(text, 120), fields, reason, "content_session_id", by_content))
    return out


def _documents(rows: DataFrame, key: Column, body: Column, title: Column, fields: list, reason: Column, session: str, index: DataFrame) -> DataFrame:
    joined = rows.join(index, F.col(session) == F.col("session_key"), "left")
    meta = F.to_json(F.struct(*fields, F.from_json("session", "project string, status string, custom_title string").alias("session")))
    project = F.col("project") if "project" in rows.columns else F.get_json_object("session", "$.project")
    return joined.select(F.lit("claude-mem").alias("source"), key.alias("external_id"), project.alias("collection"), title.alias("title"), body.alias("body"), meta.alias("metadata"), reason.alias("skip_reason"))


def plan_materials(rows: DataFrame) -> DataFrame:
    """Notes of course material rows (`id, file_name, course_id, text_status, superseded_by`, `units` array of
    `unit_no, unit_kind, text`): path and body, or the first reason to skip in order of precedence."""
    key = lambda c: F.concat(F.lit("material-file-"), c)
    collection = collection_for_course(F.col("course_id"))
    reason = (
        F.when(F.col("superseded_by").isNotNull(), F.concat(F.lit("superseded by "), key(F.col("superseded_by"))))
        .when(F.col("text_status").isNotNull() & (F.col("text_status") != "extracted"), F.concat(F.lit("text_status is "), "text_status"))
        .when(F.coalesce(F.size("units"), F.lit(0)) <= 0, "no text units")
        .when(_clean("course_id").isNull(), "no course id yet")
        .when(collection == "", "unknown form of course id")
    )
    parts = F.transform(F.array_sort("units"), lambda u: F.concat(F.lit("## "), F.initcap(u["unit_kind"]), F.lit(" "), u["unit_no"].cast("string"), F.lit("\n\n"), F.trim(u["text"])))
    body = F.concat(F.lit("# "), F.col("file_name"), F.lit("\n\n"), F.array_join(parts, "\n\n"))
    path = F.concat(F.lit("classes/"), collection, F.lit("/materials/"), file_slug(F.col("file_name")), F.lit("-"), F.col("id").cast("string"), F.lit(".md"))
    return rows.select(key(F.col("id")).alias("external_id"), reason.alias("skip_reason"), F.when(reason.isNull(), path).alias("path"), F.when(reason.isNull(), body).alias("body"))


TRANSCRIPT = "type string, isSidechain boolean, uuid string, timestamp string, sessionId string, cwd string, gitBranch string, version string, origin struct<kind: string>, message string, toolUseResult string"


def scan_transcripts(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """Lines of JSONL transcripts with their file; lines that are no JSON object are dropped."""
    lines = spark.read.text(paths).select(F.col("_metadata.file_name").alias("file_name"), "value")
    parsed = lines.withColumn("entry", F.from_json("value", TRANSCRIPT + ", _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    return parsed.filter("entry IS NOT NULL AND entry._bad IS NULL").select("file_name", "entry.*").drop("_bad")


def pair_tool_calls(lines: DataFrame) -> DataFrame:
    """Calls of tools with the lines that answer them (`line_id, message`): joined on the call's id, calls
    without an answer kept."""
    block = "array<struct<type: string, id: string, name: string, tool_use_id: string>>"
    blocks = lines.select("line_id", F.explode(F.from_json(F.get_json_object("message", "$.content"), block)).alias("b"))
    calls = blocks.filter("b.type = 'tool_use' AND b.id IS NOT NULL").groupBy(F.col("b.id").alias("call_id")).agg(F.min("line_id").alias("call_line"), F.min("b.name").alias("tool"))
    answers = blocks.filter("b.type = 'tool_result' AND b.tool_use_id IS NOT NULL").groupBy(F.col("b.tool_use_id").alias("call_id")).agg(F.min("line_id").alias("answer_line"))
    return calls.join(answers, "call_id", "left")


def tool_counts(lines: DataFrame) -> DataFrame:
    """Tools by number of calls, then by name."""
    block = "array<struct<type: string, name: string>>"
    used = lines.select(F.explode(F.from_json(F.get_json_object("message", "$.content"), block)).alias("b")).filter("b.type = 'tool_use' AND b.name IS NOT NULL")
    return used.groupBy(F.col("b.name").alias("tool")).agg(F.count("*").alias("n_calls")).orderBy(F.desc("n_calls"), "tool")
