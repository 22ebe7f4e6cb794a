"""Commits and pull requests: a log in separated records, windows of time, membership of the main branch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwork.functions.text import conventional, normal_path

RECORD, UNIT = "\x1e", "\x1f"


def parse_log(log: DataFrame, *, text: str = "log") -> DataFrame:
    """Commits of texts in the form `RS sha US date US subject US body US` followed by NUL-ended file names:
    `sha, committed_at, subject, body, files, commit_type, scope, breaking`, each sha once."""
    records = log.select(F.explode(F.split(F.col(text), RECORD)).alias("record")).filter("record != ''")
    parts = records.select(F.split("record", UNIT).alias("p")).filter(F.size("p") >= 5)
    files = F.filter(F.transform(F.split(F.element_at("p", 5), "\x00"), lambda x: F.trim(F.regexp_replace(x, r"^[\r\n]+|[\r\n]+$", ""))), lambda x: x != "")
    rows = parts.select(F.trim(F.element_at("p", 1)).alias("sha"), F.to_timestamp(F.element_at("p", 2)).alias("committed_at"), F.element_at("p", 3).alias("subject"), F.element_at("p", 4).alias("body"), files.alias("files"))
    once = rows.groupBy("sha").agg(*[F.first(c).alias(c) for c in ("committed_at", "subject", "body", "files")])
    return once.select("*", *[v.alias(k) for k, v in conventional(F.col("subject"), F.col("body")).items()])


def mark_main(commits: DataFrame, main: DataFrame) -> DataFrame:
    """Commits with whether the main branch holds them."""
    return commits.join(main.select("sha", F.lit(True).alias("on_main")).distinct(), "sha", "left").withColumn("on_main", F.coalesce("on_main", F.lit(False)))


def pull_requests_in(sessions: DataFrame, pulls: DataFrame) -> DataFrame:
    """Pull requests created, merged or closed inside a session's span (`repo, started_at, ended_at` against
    `repo, number, created_at, merged_at, closed_at`). The three times become rows, joined by repository and day."""
    stamps = pulls.select("repo", "number", F.explode(F.array("created_at", "merged_at", "closed_at")).alias("at")).filter("at IS NOT NULL").withColumn("day", F.to_date("at"))
    days = sessions.withColumn("day", F.explode(F.sequence(F.to_date("started_at"), F.to_date("ended_at"), F.expr("INTERVAL 1 DAY"))))
    return days.join(stamps, ["repo", "day"]).filter("at BETWEEN started_at AND ended_at").select("session_id", "repo", "number").distinct()


def touched_files(commits: DataFrame) -> DataFrame:
    """Files by number of commits that touch them, by normal path."""
    return commits.select(F.explode(F.array_distinct(F.transform("files", lambda f: normal_path(f)))).alias("path")).groupBy("path").agg(F.count("*").alias("n_commits"))
