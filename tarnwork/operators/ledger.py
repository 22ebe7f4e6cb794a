"""Steps of the curator on notes, issues and requirements: scopes, roles, items, rounds, summaries and proofs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnwork.functions.text import comparable, normal_path, to_posix

# States of requirements, and the order in which open ones are listed.
STATES = ["not started", "in progress", "claimed done", "verified", "contradicted"]
OPEN_ORDER = ["contradicted", "claimed done", "in progress", "not started"]
# The field of an item's text by its type; issues and requirements survive otherwise.
TEXT_FIELD = {"decision": "summary", "status_claim": "claim", "open_question": "question"}


def in_realm(metadata: Column, realm: str | None) -> Column:
    """Whether a row belongs to a realm; without a name, whether it names none (rows older than realms)."""
    named = F.get_json_object(metadata, "$._ingest.realm")
    if realm is not None:
        return F.coalesce(named == realm, F.lit(False))
    return F.coalesce(~F.array_contains(F.json_object_keys(F.get_json_object(metadata, "$._ingest")), "realm"), F.lit(True))


def excluded_by(cwd: Column, folder: Column, excludes: list[str]) -> Column:
    """The first of `excludes` that a working directory or the folder its name is encoded to contains, whatever the case
    and slashes; empty when none does."""
    here, encoded = F.lower(to_posix(cwd)), F.lower(F.coalesce(folder, F.lit("")))
    out = F.lit("")
    for segment in reversed([e for e in excludes if e]):
        needle = segment.replace("\\", "/").lower()
        hit = here.contains(needle) | encoded.contains("".join(c if c.isascii() and c.isalnum() else "-" for c in needle))
        out = F.when(hit, segment).otherwise(out)
    return out


def with_children(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """Every document with its chunks (`chunk_index`, `chunk_id`) in order; one without any keeps an empty array."""
    held = chunks.groupBy(F.col("document_id").alias("of")).agg(F.array_sort(F.collect_list(F.struct("chunk_index", "chunk_id"))).alias("children"))
    none = F.array().cast("array<struct<chunk_index:int,chunk_id:bigint>>")
    return documents.join(held, F.col("document_id") == F.col("of"), "left").drop("of").withColumn("children", F.coalesce("children", none))


def members_of(members: DataFrame, issues: DataFrame, collection: str) -> DataFrame:
    """Members of the issues of a collection."""
    return members.join(issues.filter(F.col("collection") == collection), "issue_id")


def role_of(path: Column, parent_session: Column) -> Column:
    """Role of a note by its path within a collection: `session`, `subagent`, `decision` or `note`."""
    top = F.when(path.contains("/"), F.substring_index(path, "/", 1)).otherwise("")
    stem = F.regexp_replace(F.substring_index(path, "/", -1), r"\.[^.]*$", "")
    worker = stem.contains("--") | (F.trim(F.coalesce(parent_session, F.lit(""))) != "")
    return F.when(top == "sessions", F.when(worker, "subagent").otherwise("session")).when(top == "decisions", "decision").otherwise("note")


def commits_of(notes: DataFrame, commits: DataFrame) -> DataFrame:
    """`note_id` and `n_commits`: the commits that a note names by prefixes (seven hexadecimal digits or more, each naming
    exactly one); a session's note that names none has those of its day. `notes`: `note_id`, `role`, `at`, `named` (array);
    `commits`: `sha`, `at`."""
    prefix = F.explode(F.array_distinct(F.transform("named", lambda p: F.lower(F.trim(p)))))
    asked = notes.select("note_id", prefix.alias("prefix")).filter(F.col("prefix").rlike("^[0-9a-f]{7,40}$"))
    heads = commits.select("sha").distinct().withColumn("head", F.substring("sha", 1, 7))
    one = asked.join(heads, (F.substring("prefix", 1, 7) == F.col("head")) & F.col("sha").startswith(F.col("prefix"))).groupBy("note_id", "prefix").agg(F.count("*").alias("n"), F.min("sha").alias("sha")).filter("n = 1")
    found = one.groupBy("note_id").agg(F.count_distinct("sha").alias("n_named"))
    days = commits.groupBy(F.to_date("at").alias("day")).agg(F.count("*").alias("n_day"))
    joined = notes.join(found, "note_id", "left").join(days, F.to_date(notes["at"]) == F.col("day"), "left")
    fallback = F.when(F.col("role") == "session", F.coalesce("n_day", F.lit(0))).otherwise(0)
    return joined.select("note_id", F.when(F.size(F.coalesce("named", F.array().cast("array<string>"))) > 0, F.coalesce("n_named", F.lit(0))).otherwise(fallback).alias("n_commits"))


def issue_items(notes: DataFrame, extractions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Issue items of the notes' extractions, and problems.

    `notes`: `note_id`, `content_hash`, `path`, `at`; `extractions`: `note_id`, `content_hash`, `items` (array of structs with
    `type`, `summary`, `claim`, `evidence`). Of notes with the same id and content the first path counts. Items carry the
    order in which they are worked through: time, path, place. Problems: `no date` and `malformed item` a piece."""
    one = notes.groupBy("note_id", "content_hash").agg(F.min_by(F.struct("path", "at"), "path").alias("n")).select("note_id", "content_hash", "n.*")
    rows = one.join(extractions, ["note_id", "content_hash"]).select("note_id", "path", "at", F.posexplode("items").alias("item_index", "item")).filter("item.type = 'issue'")
    whole = (F.trim("item.summary") != "") & F.col("item.claim").isNotNull() & F.col("item.evidence").isNotNull()
    problem = F.when(F.col("at").isNull(), "no date").when(~F.coalesce(whole, F.lit(False)), "malformed item")
    judged = rows.withColumn("problem", problem)
    good = judged.filter("problem IS NULL").select("at", "path", "item_index", "note_id", F.trim("item.summary").alias("summary"), F.col("item.claim").alias("claim"))
    return good, judged.filter("problem IS NOT NULL").select("path", "item_index", "problem")


def union_files(files: DataFrame, *, issue: str = "issue_id", order: list[str] | None = None) -> DataFrame:
    """Files of each issue, one spelling (the first) of each normalised path, in order. `files`: the issue, the `order`
    columns and `name`."""
    order = order or ["place"]
    keyed = files.withColumn("key", normal_path(F.col("name"))).filter("key != ''")
    first = keyed.groupBy(issue, "key").agg(F.min(F.struct(*order, "name")).alias("f"))
    return first.groupBy(issue).agg(F.transform(F.array_sort(F.collect_list("f")), lambda f: f["name"]).alias("files"))


def merge_edits(edits: DataFrame, *, group: str, cap: int | None = None) -> DataFrame:
    """Edits of each path of a group summed up, with `place` by number of edits, then path; at most `cap`."""
    total = edits.groupBy(group, "path").agg(F.sum("edits").alias("edits"))
    placed = total.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy(F.desc("edits"), "path")))
    return placed if cap is None else placed.filter(F.col("place") <= cap)


def score_summary(scores: DataFrame, top: int = 5) -> DataFrame:
    """For each collection how many notes are scored, the mean impact to two places, for how many importance was asked,
    and the notes with most impact. `scores`: `collection`, `note_id`, `impact`, `importance`."""
    sums = scores.groupBy("collection").agg(F.count("*").alias("scored"), F.round(F.avg("impact"), 2).alias("mean_impact"), F.count("importance").alias("importance_asked"))
    place = F.row_number().over(Window.partitionBy("collection").orderBy(F.desc("impact"), "note_id"))
    best = scores.select("collection", "note_id", place.alias("place")).filter(F.col("place") <= top).groupBy("collection").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "note_id"))), lambda x: x["note_id"]).alias("top_notes"))
    return sums.join(best, "collection")


def state_counts(rows: DataFrame, *, group: str, state: str, states: list[str]) -> DataFrame:
    """How many rows of each group are in each of `states`, those without any included; other states don't count."""
    spine = rows.select(group).distinct().select(group, F.explode(F.array(*map(F.lit, states))).alias("state"))
    counts = rows.groupBy(F.col(group).alias("of"), F.col(state).alias("in_state")).agg(F.count("*").alias("n"))
    return spine.join(counts, F.col(group).eqNullSafe(F.col("of")) & (F.col("state") == F.col("in_state")), "left").select(group, "state", F.coalesce("n", F.lit(0)).alias("n"))


def open_rounds(rounds: DataFrame) -> DataFrame:
    """The latest round of each action where proposals of it are undecided. `rounds`: `action`, `report_day`, `undecided`."""
    last = rounds.groupBy("action").agg(F.max_by("undecided", "report_day").alias("undecided"), F.max("report_day").alias("report_day"))
    return last.filter("undecided > 0").select("action", "report_day", "undecided")


def open_items(requirements: DataFrame) -> DataFrame:
    """Requirements not verified, as one text each, with the urgency of their state (1 the greatest). `requirements`:
    `requirement_id`, `title`, `state`, `latest_claim`."""
    text = F.concat(F.trim(F.concat_ws(" ", "requirement_id", F.coalesce("title", F.lit("")))), F.coalesce(F.concat(F.lit(" — "), "latest_claim"), F.lit("")))
    urgency = F.array_position(F.array(*map(F.lit, OPEN_ORDER)), F.col("state"))
    return requirements.filter(F.col("state") != "verified").select("requirement_id", urgency.cast("int").alias("urgency"), text.alias("text"))


def no_loss(candidates: DataFrame, remaining: DataFrame, *, group: str) -> DataFrame:
    """Whether every item of each group's candidates survives among the remaining items.

    Items: `item_type`, `text` (the field of `TEXT_FIELD`), `requirement_id`; candidates also the group and `ledgered`. An
    issue survives in the ledger only, a requirement by its id, the others by their comparable text and, where they name a
    requirement, its id too. Items of other types never survive."""
    same = lambda c: comparable(F.col(c))
    texts = remaining.filter(F.col("item_type").isin(list(TEXT_FIELD))).select(F.col("item_type").alias("held_type"), same("text").alias("held_text")).distinct()
    ids = remaining.filter("item_type IN ('requirement', 'status_claim') AND requirement_id IS NOT NULL").select(F.col("requirement_id").alias("held_id")).distinct()
    found = candidates.withColumn("plain", same("text")).join(texts, (F.col("item_type") == F.col("held_type")) & (F.col("plain") == F.col("held_text")), "left").join(ids, F.col("requirement_id") == F.col("held_id"), "left")
    by_text = F.col("item_type").isin(list(TEXT_FIELD)) & (F.col("plain") != "") & F.col("held_text").isNotNull() & (F.col("requirement_id").isNull() | F.col("held_id").isNotNull())
    survives = F.when(F.col("item_type") == "issue", F.coalesce("ledgered", F.lit(False))).when(F.col("item_type") == "requirement", F.col("held_id").isNotNull()).otherwise(by_text)
    return found.groupBy(group).agg(F.count("*").alias("n_items"), F.count_if(~F.coalesce(survives, F.lit(False))).alias("n_lost"))


def resolve_narrative(paragraphs: DataFrame, refs: DataFrame) -> DataFrame:
    """Paragraphs of answers with labels read back to notes: `answer_id`, `place`, `text` on one line, `note_ids` in the
    order of the timeline, and `dropped_cites`. A paragraph without text or known label has null `note_ids` and is dropped by
    the reader. `paragraphs`: `answer_id`, `place`, `text`, `cites`; `refs`: `answer_id`, `label`, `note_id`, `timeline`."""
    first = refs.groupBy(F.col("answer_id").alias("of"), "note_id").agg(F.min("timeline").alias("since"))
    known = refs.select(F.col("answer_id").alias("of"), "label", "note_id").join(first, ["of", "note_id"])
    cited = paragraphs.select("answer_id", "place", F.explode("cites").alias("cite")).join(known, (F.col("answer_id") == F.col("of")) & (F.col("cite") == F.col("label")), "left")
    read = cited.groupBy("answer_id", "place").agg(F.array_sort(F.collect_set(F.when(F.col("note_id").isNotNull(), F.struct("since", "note_id")))).alias("found"), F.count_if(F.col("note_id").isNull()).alias("dropped_cites"))
    text = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", " "))
    kept = (F.col("text") != "") & (F.size("found") > 0)
    out = paragraphs.select("answer_id", "place", text.alias("text")).join(read, ["answer_id", "place"], "left")
    return out.select("answer_id", "place", "text", F.when(kept, F.transform("found", lambda x: x["note_id"])).alias("note_ids"), F.coalesce("dropped_cites", F.lit(0)).alias("dropped_cites"))
