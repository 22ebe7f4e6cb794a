"""Queries of the curator's steps over the project's test tables, with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwork.functions.text import project_folder
from tarnwork.operators import ledger
from tarnwork.operators.ranking import number_rows
from tarnwork.runtime import table

EXCLUDES = ["\\Tools\\", "", "harbor", "web"]


def realm_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of the realm `curator`, of no realm, and of others."""
    meta = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit('{"_ingest":{"realm":"'), "source", F.lit('"}}'))).when(F.col("doc_id") % 3 == 1, '{"_ingest":{"run":1}}').otherwise("{}")
    docs = table(spark, sf_dir, "documents").select("doc_id", meta.alias("metadata"))
    scope = F.when(ledger.in_realm(F.col("metadata"), "curator"), "curator").when(ledger.in_realm(F.col("metadata"), None), "none").otherwise("other")
    return docs.select("doc_id", scope.alias("scope"))


def excluded_cwd(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "sessions").select("session_id", "captured_at", "cwd")
    return rows.select("session_id", "captured_at", ledger.excluded_by(F.col("cwd"), project_folder(F.col("cwd")), EXCLUDES).alias("excluded"))


def childless(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with the blocks of the note of the same number, of which many have none."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"))
    parts = table(spark, sf_dir, "note_blocks").select((F.col("block_id") % 700).alias("document_id"), F.col("block_index").alias("chunk_index"), F.col("block_id").alias("chunk_id"))
    out = ledger.with_children(docs, parts)
    return out.select("document_id", F.size("children").alias("n_children"), F.array_join(F.transform("children", lambda c: F.concat(c["chunk_index"].cast("string"), F.lit(":"), c["chunk_id"].cast("string"))), " ").alias("children"))


def issue_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels whose document lies in the collection with most documents."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("issue_id"), F.col("collection_key").alias("collection"))
    top = docs.filter("collection IS NOT NULL").groupBy("collection").count().orderBy(F.desc("count"), "collection").first()
    members = table(spark, sf_dir, "subject_labels").select(F.col("doc_id").alias("issue_id"), "subject")
    return ledger.members_of(members, docs, top[0] if top else "").groupBy("issue_id", "collection").agg(F.count("*").alias("n_members"))


def note_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    agent = F.col("agent_id")
    path = F.when(F.col("record_id") % 4 == 0, F.concat(F.lit("decisions/"), agent, F.lit(".md"))).when(F.col("record_id") % 4 == 1, F.concat(F.lit("sessions/s--"), agent, F.lit(".md"))).when(F.col("record_id") % 4 == 2, F.concat(F.lit("sessions/"), agent, F.lit(".md"))).otherwise(F.concat(agent, F.lit(".md")))
    rows = table(spark, sf_dir, "subagents").select("record_id", path.alias("path"), "parent_agent_id")
    return rows.select("record_id", ledger.role_of(F.col("path"), F.col("parent_agent_id")).alias("role"))


def note_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions' commits: rows of the stream as commits, named by prefixes or of the same day."""
    commits = table(spark, sf_dir, "events").select(F.sha1(F.col("event_id").cast("string")).alias("sha"), F.col("ts").alias("at"))
    sha = F.sha1(F.col("line_id").cast("string"))
    named = F.when(F.col("line_id") % 3 == 0, F.array(F.upper(F.substring(sha, 1, 9)), F.lit("xyz"), F.substring(sha, 1, 6))).when(F.col("line_id") % 3 == 1, F.array().cast("array<string>"))
    shifted = F.timestamp_micros(F.unix_micros(F.lit("2024-01-01").cast("timestamp")) + (F.col("line_id") % 400) * 86_400_000_000)
    notes = table(spark, sf_dir, "sdk_review").select(F.col("line_id").alias("note_id"), F.when(F.col("line_id") % 2 == 0, "session").otherwise("subagent").alias("role"), shifted.alias("at"), named.alias("named"))
    return ledger.commits_of(notes, commits)


def collected_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issue items read from labels of documents, in working order."""
    docs = table(spark, sf_dir, "documents").select("external_id", F.col("doc_id").cast("string").alias("note_id"), F.lit("h").alias("content_hash"), F.when(F.col("doc_id") % 10 != 0, F.col("created_at")).alias("at")).withColumnRenamed("external_id", "path")
    item = F.struct(F.when(F.col("subject") == "software", "decision").otherwise("issue").alias("type"), F.col("subject").alias("summary"), F.col("labelled_by").alias("claim"), F.lit("e").alias("evidence"))
    found = table(spark, sf_dir, "subject_labels").groupBy(F.col("doc_id").cast("string").alias("note_id")).agg(F.array_sort(F.collect_list(item)).alias("items")).withColumn("content_hash", F.lit("h"))
    good, bad = ledger.issue_items(docs, found)
    return good.groupBy("note_id").agg(F.count("*").alias("n")).withColumn("problem", F.lit("")).unionByName(bad.groupBy("path", "problem").agg(F.count("*").alias("n")).select(F.col("path").alias("note_id"), "n", "problem"))


def issue_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.when(F.col("prompt_count") % 2 == 0, F.concat(F.lit("./"), "cwd")).otherwise(F.replace("cwd", F.lit("/"), F.lit("//")))
    rows = table(spark, sf_dir, "sessions").select(F.col("repo").alias("issue_id"), "captured_at", "session_id", name.alias("name"))
    return ledger.union_files(rows, order=["captured_at", "session_id"]).select("issue_id", F.size("files").alias("n_files"), F.array_join("files", "|").alias("files"))


def edit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "transcript_lines").filter("session_id IS NOT NULL").select("session_id", F.concat("line_type", F.lit("/"), F.col("line_no") % 7).alias("path"), F.col("line_no").cast("bigint").alias("edits"))
    return ledger.merge_edits(rows, group="session_id", cap=3)


def score_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").filter("collection_key IS NOT NULL").select(F.col("collection_key").alias("collection"), F.col("doc_id").alias("note_id"), ((F.col("doc_id") * 37 % 100) / 8).alias("impact"), F.when(F.col("doc_id") % 4 == 0, 1).alias("importance"))
    return ledger.score_summary(rows).select("collection", "scored", "mean_impact", "importance_asked", F.array_join(F.transform("top_notes", lambda x: x.cast("string")), " ").alias("top_notes"))


def state_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.state_counts(table(spark, sf_dir, "sessions").filter("repo IS NOT NULL"), group="repo", state="session_status", states=["planning", "active", "concluded", "superseded", "never"])


def open_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "subject_labels").groupBy(F.lower(F.trim("subject")).alias("action"), F.to_date("labelled_at").alias("report_day")).agg(F.count_if(F.col("labelled_by").isNull() | (F.col("doc_id") % 2 == 0)).alias("undecided"))
    return ledger.open_rounds(rows)


def open_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = F.element_at(F.array(*map(F.lit, ledger.STATES)), (F.col("doc_id") % 5 + 1).cast("int"))
    rows = table(spark, sf_dir, "documents").select(F.concat(F.lit("R-"), "doc_id").alias("requirement_id"), "title", state.alias("state"), F.when(F.col("doc_id") % 3 == 0, F.col("source")).alias("latest_claim"))
    return ledger.open_items(rows)


def no_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether what even records say is still said by odd ones of any session."""
    kind = F.element_at(F.array(*map(F.lit, ["decision", "issue", "requirement", "open_question", "unknown"])), (F.col("record_id") % 5 + 1).cast("int"))
    rows = table(spark, sf_dir, "subagents").select("session_id", "record_id", kind.alias("item_type"), F.col("description").alias("text"), F.when(F.col("record_id") % 7 < 3, F.concat(F.lit("R-"), F.col("record_id") % 11)).alias("requirement_id"), (F.col("record_id") % 4 == 0).alias("ledgered"))
    return ledger.no_loss(rows.filter("record_id % 2 = 0"), rows.filter("record_id % 2 = 1"), group="session_id")


def narrative(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks as paragraphs that cite their own and the next block's label, of which a third is unknown."""
    one = table(spark, sf_dir, "note_blocks").groupBy("note_id", "block_index").agg(F.min_by("block_text", "block_id").alias("text"))
    label = lambda k: F.concat(F.lit("S"), (F.col("block_index") + k).cast("string"))
    parts = one.select(F.col("note_id").alias("answer_id"), F.col("block_index").alias("place"), "text", F.array(label(1), label(0), F.lit("X")).alias("cites"))
    refs = one.filter("block_index % 3 != 0").select(F.col("note_id").alias("answer_id"), label(0).alias("label"), F.concat(F.lit("n"), F.col("block_index") % 4).alias("note_id"), F.col("block_index").alias("timeline"))
    out = ledger.resolve_narrative(parts, refs)
    return out.select("answer_id", "place", F.md5("text").alias("text"), F.array_join("note_ids", " ").alias("note_ids"), "dropped_cites")


def nulls_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents numbered by collection, those without one first."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "collection_key", F.lit(0).alias("all"), F.col("collection_key").isNotNull().alias("has"), F.coalesce("collection_key", F.lit("")).alias("name"))
    return number_rows(docs, group=["all"], order=["has", "name", "doc_id"]).select("doc_id", "place")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "realm_scope": realm_scope, "excluded_cwd": excluded_cwd, "childless_documents": childless, "issue_members": issue_members, "note_roles": note_roles, "note_commits": note_commits, "collected_items": collected_items, "issue_files": issue_files,
    "edit_counts": edit_counts, "score_summary": score_summary, "state_counts": state_counts, "open_rounds": open_rounds, "open_items": open_items, "no_loss": no_loss, "narrative": narrative, "nulls_first": nulls_first,
}

_PLAIN = r"trim(regexp_replace(regexp_replace(lower(coalesce({0}, '')), '[^\p{{L}}\p{{N}}_\s]', '', 'g'), '\s+', ' ', 'g'))"

ORACLES: dict[str, str] = {
    "realm_scope": "SELECT doc_id, CASE WHEN doc_id % 3 = 0 AND source = 'curator' THEN 'curator' WHEN doc_id % 3 <> 0 THEN 'none' ELSE 'other' END AS scope FROM documents",
    "excluded_cwd": r"""SELECT session_id, captured_at, CASE WHEN contains(lower(replace(cwd, '\', '/')), '/tools/') OR contains(lower(regexp_replace(cwd, '[^A-Za-z0-9]', '-', 'g')), '-tools-') THEN '\Tools\'
  WHEN contains(lower(cwd), 'harbor') THEN 'harbor' WHEN contains(lower(cwd), 'web') THEN 'web' ELSE '' END AS excluded FROM sessions""",
    "childless_documents": """SELECT d.doc_id AS document_id, count(b.block_id) AS n_children, coalesce(string_agg(b.block_index || ':' || b.block_id, ' ' ORDER BY b.block_index, b.block_id), '') AS children
FROM documents d LEFT JOIN note_blocks b ON b.block_id % 700 = d.doc_id GROUP BY 1""",
    "issue_members": """SELECT d.doc_id AS issue_id, d.collection_key AS collection, count(*) AS n_members FROM subject_labels l JOIN documents d USING (doc_id)
WHERE d.collection_key = (SELECT collection_key FROM documents WHERE collection_key IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) GROUP BY 1, 2""",
    "note_roles": """SELECT record_id, CASE record_id % 4 WHEN 0 THEN 'decision' WHEN 1 THEN 'subagent' WHEN 2 THEN CASE WHEN contains(agent_id, '--') OR trim(coalesce(parent_agent_id, '')) <> '' THEN 'subagent' ELSE 'session' END ELSE 'note' END AS role FROM subagents""",
    "note_commits": """WITH c AS (SELECT sha1(CAST(event_id AS VARCHAR)) AS sha, CAST(ts AS DATE) AS day FROM events), d AS (SELECT day, count(*) AS n FROM c GROUP BY 1),
  p AS (SELECT line_id, substr(sha1(CAST(line_id AS VARCHAR)), 1, 9) AS prefix FROM sdk_review WHERE line_id % 3 = 0),
  f AS (SELECT line_id, CASE WHEN count(DISTINCT sha) = 1 THEN 1 ELSE 0 END AS n FROM p JOIN c ON substr(c.sha, 1, 9) = p.prefix GROUP BY 1)
SELECT s.line_id AS note_id, CASE WHEN s.line_id % 3 = 0 THEN coalesce(f.n, 0) WHEN s.line_id % 2 = 0 THEN coalesce(d.n, 0) ELSE 0 END AS n_commits
FROM sdk_review s LEFT JOIN f USING (line_id) LEFT JOIN d ON d.day = DATE '2024-01-01' + CAST(s.line_id % 400 AS INTEGER)""",
    "collected_items": """WITH l AS (SELECT d.doc_id, d.external_id, d.doc_id % 10 = 0 AS undated, l.subject, l.labelled_by FROM subject_labels l JOIN documents d USING (doc_id) WHERE l.subject IS DISTINCT FROM 'software'),
  j AS (SELECT *, CASE WHEN undated THEN 'no date' WHEN coalesce(trim(subject), '') = '' OR labelled_by IS NULL THEN 'malformed item' ELSE '' END AS problem FROM l)
SELECT CASE WHEN problem = '' THEN CAST(doc_id AS VARCHAR) ELSE external_id END AS note_id, count(*) AS n, problem FROM j GROUP BY 1, 3""",
    "issue_files": r"""WITH r AS (SELECT repo, captured_at, session_id, CASE WHEN prompt_count % 2 = 0 THEN './' || cwd ELSE replace(cwd, '/', '//') END AS name FROM sessions),
  k AS (SELECT *, array_to_string(list_filter(string_split(replace(name, '\', '/'), '/'), lambda x: x <> '' AND x <> '.'), '/') AS key FROM r),
  f AS (SELECT * FROM k WHERE key <> '' QUALIFY row_number() OVER (PARTITION BY repo, key ORDER BY captured_at, session_id, name) = 1)
SELECT repo AS issue_id, count(*) AS n_files, string_agg(name, '|' ORDER BY captured_at, session_id, name) AS files FROM f GROUP BY 1""",
    "edit_counts": """WITH t AS (SELECT session_id, line_type || '/' || (line_no % 7) AS path, CAST(sum(line_no) AS BIGINT) AS edits FROM transcript_lines WHERE session_id IS NOT NULL GROUP BY 1, 2)
SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY edits DESC, path) AS place FROM t QUALIFY place <= 3""",
    "score_summary": """WITH s AS (SELECT collection_key AS collection, doc_id, (doc_id * 37 % 100) / 8 AS impact, row_number() OVER (PARTITION BY collection_key ORDER BY doc_id * 37 % 100 DESC, doc_id) AS place FROM documents WHERE collection_key IS NOT NULL)
SELECT collection, count(*) AS scored, round(avg(impact), 2) AS mean_impact, count(*) FILTER (WHERE doc_id % 4 = 0) AS importance_asked, string_agg(CAST(doc_id AS VARCHAR), ' ' ORDER BY place) FILTER (WHERE place <= 5) AS top_notes FROM s GROUP BY 1""",
    "state_counts": """SELECT repo, state, count(s.session_id) AS n FROM (SELECT DISTINCT repo FROM sessions WHERE repo IS NOT NULL) r CROSS JOIN (SELECT unnest(['planning', 'active', 'concluded', 'superseded', 'never']) AS state) t
LEFT JOIN sessions s USING (repo) WHERE false OR s.session_status = t.state GROUP BY 1, 2 UNION ALL
SELECT repo, state, 0 FROM (SELECT DISTINCT repo FROM sessions WHERE repo IS NOT NULL) r CROSS JOIN (SELECT unnest(['planning', 'active', 'concluded', 'superseded', 'never']) AS state) t
WHERE NOT EXISTS (SELECT 1 FROM sessions s WHERE s.repo = r.repo AND s.session_status = t.state)""",
    "open_rounds": """WITH r AS (SELECT lower(trim(subject)) AS action, CAST(labelled_at AS DATE) AS report_day, count(*) FILTER (WHERE labelled_by IS NULL OR doc_id % 2 = 0) AS undecided FROM subject_labels GROUP BY 1, 2)
SELECT * FROM r WHERE undecided > 0 AND report_day = (SELECT max(report_day) FROM r x WHERE x.action IS NOT DISTINCT FROM r.action)""",
    "open_items": """SELECT 'R-' || doc_id AS requirement_id, [4, 3, 2, 0, 1][doc_id % 5 + 1] AS urgency, trim('R-' || doc_id || ' ' || coalesce(title, '')) || CASE WHEN doc_id % 3 = 0 THEN coalesce(' — ' || source, '') ELSE '' END AS text FROM documents WHERE doc_id % 5 <> 3""",
    "no_loss": f"""WITH r AS (SELECT session_id, record_id, ['decision', 'issue', 'requirement', 'open_question', 'unknown'][record_id % 5 + 1] AS t, {_PLAIN.format('description')} AS plain, CASE WHEN record_id % 7 < 3 THEN 'R-' || (record_id % 11) END AS rid FROM subagents),
  texts AS (SELECT DISTINCT t, plain FROM r WHERE record_id % 2 = 1 AND t IN ('decision', 'open_question')), ids AS (SELECT DISTINCT rid FROM r WHERE record_id % 2 = 1 AND t = 'requirement' AND rid IS NOT NULL),
  c AS (SELECT r.*, CASE WHEN t = 'issue' THEN record_id % 4 = 0 WHEN t = 'requirement' THEN coalesce(rid IN (SELECT rid FROM ids), false)
    WHEN t = 'unknown' THEN false ELSE plain <> '' AND EXISTS (SELECT 1 FROM texts x WHERE x.t = r.t AND x.plain = r.plain) AND (rid IS NULL OR rid IN (SELECT rid FROM ids)) END AS kept FROM r WHERE record_id % 2 = 0)
SELECT session_id, count(*) AS n_items, count(*) FILTER (WHERE NOT kept) AS n_lost FROM c GROUP BY 1""",
    "narrative": r"""WITH one AS (SELECT note_id, block_index, arg_min(block_text, block_id) FILTER (WHERE true) AS text, first(block_text ORDER BY block_id) AS whole FROM note_blocks GROUP BY 1, 2),
  since AS (SELECT note_id, block_index % 4 AS n, min(block_index) AS since FROM one WHERE block_index % 3 <> 0 GROUP BY 1, 2),
  c AS (SELECT o.note_id, o.block_index, r.block_index AS hit, s.n, s.since FROM (SELECT note_id, block_index, unnest([block_index + 1, block_index]) AS at FROM one) o LEFT JOIN one r ON r.note_id = o.note_id AND r.block_index = o.at AND r.block_index % 3 <> 0 LEFT JOIN since s ON s.note_id = r.note_id AND s.n = r.block_index % 4),
  g AS (SELECT note_id, block_index, count(*) FILTER (WHERE hit IS NULL) + 1 AS dropped, array_to_string(list_transform(list_sort(list_distinct(list(struct_pack(since := since, n := n)) FILTER (WHERE hit IS NOT NULL))), lambda x: 'n' || x.n), ' ') AS ids FROM c GROUP BY 1, 2)
SELECT o.note_id AS answer_id, o.block_index AS place, md5(trim(regexp_replace(coalesce(o.whole, ''), '\s+', ' ', 'g'))) AS text, CASE WHEN trim(regexp_replace(coalesce(o.whole, ''), '\s+', ' ', 'g')) <> '' THEN nullif(g.ids, '') END AS note_ids, g.dropped AS dropped_cites FROM one o JOIN g USING (note_id, block_index)""",
    "nulls_first": "SELECT doc_id, row_number() OVER (ORDER BY collection_key NULLS FIRST, doc_id) AS place FROM documents",
}
