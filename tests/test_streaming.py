"""Streams give what the same batch gives, and survive a restart."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tarnwork.streaming import sessions

BASE = datetime(2026, 1, 1)


def test_sessions_and_ratchet(spark):
    rows = [("a", BASE), ("a", BASE + timedelta(hours=5)), ("a", BASE + timedelta(hours=12)), ("b", BASE)]
    got = sessions.close_sessions(spark.createDataFrame(rows, "k string, at timestamp"), key="k", at="at").collect()
    assert sorted((r["k"], r["n_events"]) for r in got) == [("a", 1), ("a", 2), ("b", 1)]
    log = spark.createDataFrame([("a", "concluded"), ("a", "active"), ("b", "odd"), ("c", None)], "k string, s string")
    assert {r["k"]: r["status"] for r in sessions.ratchet(log, key="k", status="s").collect()} == {"a": "concluded", "b": "planning", "c": "planning"}


def test_restarted_stream(spark, tmp_path):
    source, out = tmp_path / "in", tmp_path / "out"
    put = lambda rows: spark.createDataFrame(rows, "key string, status string").coalesce(1).write.mode("append").parquet(source.as_uri())
    put([("a", "planning"), ("b", "active")])
    name = f"test-{tmp_path.name}"

    def run():
        stream = spark.readStream.schema("key string, status string").parquet(source.as_uri())
        sessions.run_available(sessions.ratchet_stream(stream, key="key", status="status"), lambda df, _: df.write.mode("append").parquet(out.as_uri()), mode="update", name=name)

    run()
    put([("a", "concluded"), ("b", "planning")])
    run()
    rows = sorted(tuple(r) for r in spark.read.parquet(out.as_uri()).collect())
    # The second batch knows the state of the first: `b` stays active though it is told to be planning.
    assert rows == [("a", "concluded"), ("a", "planning"), ("b", "active"), ("b", "active")]


def test_conclude_merge_inherit(spark):
    now = F.lit(BASE + timedelta(days=2)).cast("timestamp")
    notes = spark.createDataFrame([("a", "active", BASE), ("b", "active", BASE + timedelta(days=1, hours=12)), ("c", "superseded", BASE), ("d", None, BASE), ("e", "active", None)], "id string, session_status string, ended_at timestamp")
    got = {r["id"]: (r["next_status"], r["problem"]) for r in sessions.conclude(notes, now=now).collect()}
    assert got == {"a": ("concluded", None), "b": ("active", None), "c": ("superseded", None), "d": (None, "no status"), "e": ("active", None)}
    schema = "k string, tags array<string>, title string, repo string, started int, n int, status string"
    old = spark.createDataFrame([("x", ["a", "b"], "T", "r", 5, 3, "concluded")], schema)
    new = spark.createDataFrame([("x", ["b", "c"], "U", " ", 4, 2, "active"), ("y", None, "V", "q", 1, 1, None)], schema)
    kinds = {"tags": "list", "title": "keep", "repo": "scalar", "started": "first", "n": "count", "status": "status"}
    rows = {r["k"]: tuple(r)[1:] for r in sessions.merge_fields(old, new, "k", kinds, {"tags": 2}).collect()}
    assert rows["x"] == (["a", "b"], "T", "r", 4, 3, "concluded")
    assert rows["y"][:3] == ([], "V", "q")
    kids = spark.createDataFrame([("p", " "), ("p", "own"), ("none", None)], "parent string, repo string")
    up = spark.createDataFrame([("p", "up")], "parent string, repo string")
    assert sorted(str(r["repo"]) for r in sessions.inherit(kids, up, parent_key="parent", fields=["repo"]).collect()) == ["None", "own", "up"]
    assert [len(x) for x in sessions.hand_off(list("abcde"), 2)] == [2, 2, 1]


def test_once_and_first_copy(spark):
    df = spark.createDataFrame([("a", 1, "me"), ("a", 2, "me"), ("b", 1, "other"), (None, 1, "me"), (None, 2, "me")], "k string, n int, author string")
    assert sessions.once(df, ["k"]).count() == 3
    assert {(r["k"], r["n"]) for r in sessions.first_copies(df, "k", ["n"], ["me"]).collect()} == {("a", 1), (None, 1)}
