"""What a session's note is made of: tags, routing, resumptions, searches found in transcripts, checks of
extracted items, review lists and the opening brief."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnwork.functions.text import to_posix


@dataclass(frozen=True)
class TagRule:
    """A tag that counts the values of a source column (an array of strings) matching a pattern."""

    tag: str
    slot: str  # "area" or "activity"
    source: str
    pattern: str


def classify(df: DataFrame, rules: list[TagRule], *, key: str, phase: Column | None = None, cap: int = 5, none: str = "unclassified") -> DataFrame:
    """Tags of each row: its phase, the two areas with most matches (ties in order of the rules), the first two
    activities, then the other areas and activities, at most `cap`; `none` alone without any."""
    count = {r: F.size(_matching(r)) for r in rules}
    areas = list(dict.fromkeys(r.tag for r in rules if r.slot == "area"))
    activities = list(dict.fromkeys(r.tag for r in rules if r.slot == "activity"))
    total = lambda tag: sum((count[r] for r in rules if r.tag == tag), F.lit(0))
    scored = F.array_sort(F.filter(F.array(*[F.struct((-total(t)).alias("minus"), F.lit(k).alias("place"), F.lit(t).alias("tag")) for k, t in enumerate(areas)]), lambda x: x["minus"] < 0)) if areas else F.array()
    ranked = F.transform(scored, lambda x: x["tag"]) if areas else F.array().cast("array<string>")
    active = F.filter(F.array(*[F.when(total(t) > 0, t) for t in activities]), lambda x: x.isNotNull()) if activities else F.array().cast("array<string>")
    empty = F.array().cast("array<string>")
    first = F.when(phase.isNotNull() & (phase != ""), F.array(phase)).otherwise(empty) if phase is not None else empty
    tags = F.slice(F.array_distinct(F.concat(first, F.slice(ranked, 1, 2), F.slice(active, 1, 2), ranked, active)), 1, cap)
    return df.select(key, F.when(F.size(tags) > 0, tags).otherwise(F.array(F.lit(none))).alias("tags"))


def _matching(rule: TagRule) -> Column:
    values = F.coalesce(F.col(rule.source), F.array().cast("array<string>"))
    return F.filter(values, lambda x: x.rlike(rule.pattern))


def route(cwd: Column, *, class_folders: dict[str, str], containers: list[str], harness: str | None = None) -> Column:
    """Collection of a working directory: that of a class folder, the harness, the folder below a container
    folder, else the last folder; a deleted worktree's suffix doesn't count. `''` for no directory."""
    path = F.regexp_replace(F.regexp_replace(to_posix(cwd), "/+$", ""), r"(?:-worktree-[^/]+|/\.worktrees/[^/]+)$", "")
    out = F.element_at(F.split(path, "/"), -1)
    for root in containers:
        out = F.when(path.startswith(f"{root}/"), F.element_at(F.split(F.substring(path, len(root) + 2, 1 << 20), "/"), 1)).otherwise(out)
    if harness:
        out = F.when((path == harness) | path.startswith(f"{harness}/"), "harness").otherwise(out)
    for folder, collection in class_folders.items():
        out = F.when((path == folder) | path.startswith(f"{folder}/"), collection).otherwise(out)
    return F.lower(out)


def resume_head(notes: DataFrame, *, session: str = "session_id", index: str = "resume_index") -> DataFrame:
    """The last of each session's resumptions that follow without a gap from the first note (index 1)."""
    place = F.row_number().over(Window.partitionBy(session).orderBy(index))
    chain = notes.select(session, index).distinct().withColumn("place", place).filter(F.col(index) == F.col("place"))
    return chain.groupBy(session).agg(F.max(index).alias("head_index"))


def union_records(old: Column, new: Column, cap: int) -> Column:
    """Two arrays of records as one without repetitions, the first kept, at most `cap`."""
    empty = F.slice(new, 1, 0)
    return F.slice(F.array_distinct(F.concat(F.coalesce(old, empty), F.coalesce(new, empty))), 1, cap)


def ordered_timeline(notes: DataFrame, *, group: str, date: str, path: str) -> DataFrame:
    """Notes with their place in their group's timeline, undated ones last, then by path."""
    return notes.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy(F.col(date).asc_nulls_last(), F.col(path))))


def searches_in(lines: DataFrame, *, tools: str = r"search_context|get_document", cap: int = 100, side: bool = False) -> DataFrame:
    """Searches made in transcripts (`line_id, session_id, ts, is_sidechain, message`), each with the text that
    answered it, in order of time and at most `cap` a session. A call is joined with its answer by id."""
    block = "array<struct<type: string, id: string, name: string, tool_use_id: string, input: string, content: string>>"
    rows = lines if side else lines.filter(~F.coalesce("is_sidechain", F.lit(False)))
    blocks = rows.select("line_id", "session_id", "ts", F.explode(F.from_json(F.get_json_object("message", "$.content"), block)).alias("b"))
    calls = blocks.filter((F.col("b.type") == "tool_use") & F.col("b.name").rlike(tools)).select("line_id", "session_id", "ts", F.col("b.id").alias("call_id"), F.col("b.name").alias("tool"), F.get_json_object("b.input", "$.query").alias("query"))
    answers = blocks.filter("b.type = 'tool_result' AND b.tool_use_id IS NOT NULL").groupBy(F.col("b.tool_use_id").alias("call_id")).agg(F.min_by("b.content", "line_id").alias("answer"))
    place = F.row_number().over(Window.partitionBy("session_id").orderBy("ts", "line_id"))
    return calls.join(answers, "call_id", "left").withColumn("place", place).filter(F.col("place") <= cap)


def retrieved_links(hits: DataFrame, *, cap: int = 20) -> DataFrame:
    """Distinct notes that each session's searches returned, in order of first sight (`session_id, place, rank,
    external_id`), at most `cap`."""
    seen = hits.groupBy("session_id", "external_id").agg(F.min(F.struct("place", "rank")).alias("first_seen"))
    listed = F.array_sort(F.collect_list(F.struct("first_seen", "external_id")))
    return seen.groupBy("session_id").agg(F.slice(F.transform(listed, lambda x: x["external_id"]), 1, cap).alias("links"))


def brief_sources(notes: DataFrame, *, most: int = 5) -> DataFrame:
    """What opens a collection's next session: its status note, else its newest outcomes that aren't superseded,
    at most `most` (`collection, note_id, kind, status, at`)."""
    has_status = F.max(F.col("kind") == "status").over(Window.partitionBy("collection"))
    pool = notes.withColumn("has_status", has_status).filter((F.col("kind") == "status") | (~F.col("has_status") & (F.col("kind") == "outcome") & (F.coalesce("status", F.lit("")) != "superseded")))
    place = F.row_number().over(Window.partitionBy("collection").orderBy(F.desc("at"), "note_id"))
    return pool.withColumn("place", place).filter(F.col("place") <= F.when(F.col("has_status"), 1).otherwise(most)).select("collection", "note_id", "kind", "place")


def item_faults(items: DataFrame, *, least: int = 12, most: int = 600, summary: int = 300, pattern: str = r"[A-Z]{1,6}-?\d{1,4}[a-z]?") -> DataFrame:
    """Extracted items (`summary, evidence, body`, optionally null `requirement_id`) with what is wrong: evidence
    must be a passage of the body of fair length, the summary short, an id well formed and named in the body."""
    whole = F.concat(F.lit(r"(?:^|[^A-Za-z0-9-])\Q"), "requirement_id", F.lit(r"\E(?:[^A-Za-z0-9-]|$)"))
    length = F.length(F.trim("evidence"))
    fault = (
        F.when(F.col("evidence").isNull() | (length < least), "evidence too short").when(length > most, "evidence too long").when(~F.contains("body", F.trim("evidence")), "evidence isn't in the note")
        .when(F.coalesce(F.length(F.trim("summary")), F.lit(0)) == 0, "no summary").when(F.length("summary") > summary, "summary too long")
        .when(F.col("requirement_id").isNotNull() & ~F.col("requirement_id").rlike(f"^(?:{pattern})$"), "malformed id").when(F.col("requirement_id").isNotNull() & ~F.regexp_like("body", whole), "id isn't in the note")
    )
    return items.withColumn("fault", fault)


def untagged(notes: DataFrame, *, since: Column, tag: str = "unclassified", sdk: bool = False) -> DataFrame:
    """Notes since a time that no tag but the placeholder describes, newest first."""
    rows = notes.filter(F.array_contains("tags", tag) & (F.col("at") >= since))
    return (rows if sdk else rows.filter(~F.coalesce(F.col("origin").startswith("sdk"), F.lit(False)))).orderBy(F.desc("at"), "note_id")


def derive_issue_events(issues: DataFrame, fixes: DataFrame, commits: DataFrame, pulls: DataFrame) -> DataFrame:
    """Events of issues from commits that fix one of their files after it was seen, and from fixes that members
    name. `issues`: `issue_id, first_seen_at, files`; `fixes`: `issue_id, reference`; `commits`: `sha,
    committed_at, commit_type, files, on_main`; `pulls`: `number, merged_at`. One event per cause, the earliest."""
    from tarnwork.operators.curate import path_suffixes, resolve_prefixes

    parts = issues.select("issue_id", "first_seen_at", F.explode("files").alias("file")).withColumn("suffix", F.explode(path_suffixes(F.col("file"))))
    fixing = commits.filter("commit_type = 'fix'").select("sha", "committed_at", F.explode("files").alias("touched")).withColumn("suffix", F.explode(path_suffixes(F.col("touched"))))
    # Two paths match where one is a suffix of the other, so the shared suffix is one of them whole.
    met = parts.join(fixing, "suffix").filter("(suffix = file OR suffix = touched) AND committed_at > first_seen_at")
    by_file = met.groupBy("issue_id", "sha").agg(F.min("committed_at").alias("effective_at")).select("issue_id", F.lit("fix-commit").alias("event_kind"), F.lit("claimed-fixed").alias("to_state"), "effective_at", F.col("sha").alias("cause_ref"))
    merged = fixes.filter(F.col("reference").rlike(r"^#?\d+$")).select("issue_id", F.regexp_replace("reference", "#", "").cast("int").alias("number")).join(pulls.filter("merged_at IS NOT NULL"), "number").select("issue_id", F.lit("merged-pr").alias("event_kind"), F.lit("verified").alias("to_state"), F.col("merged_at").alias("effective_at"), F.concat(F.lit("#"), "number").alias("cause_ref"))
    named = fixes.filter(F.col("reference").rlike("^[0-9a-fA-F]{7,40}$")).withColumnRenamed("reference", "prefix")
    landed = named.join(resolve_prefixes(named.select("prefix"), commits), "prefix").join(commits.filter("on_main").select("sha", "committed_at"), "sha").select("issue_id", F.lit("fix-commit").alias("event_kind"), F.lit("verified").alias("to_state"), F.col("committed_at").alias("effective_at"), F.col("sha").alias("cause_ref"))
    every = by_file.unionByName(merged).unionByName(landed)
    return every.groupBy("issue_id", "event_kind", "to_state", "cause_ref").agg(F.min("effective_at").alias("effective_at"))
