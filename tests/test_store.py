"""Sources, store, reducers and audits on literal cases."""

import json
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tarnwork.operators import audit, curate, evaluate, ingest, reports
from tarnwork.sources import exports, git, plandocs, vault
from tarnwork.sources.store import Store


@pytest.fixture
def notes(tmp_path):
    files = {
        "projects/demo/a.md": "---\ntitle: A\nid: one\ntags: [x, y]\nwhen: 2026-01-02\nretrievals:\n  - tool: s\n---\n# H\nbody",
        "projects/demo/b.md": "---\nid: one\n---\nother",
        "projects/demo/bad.md": "---\na: [\n---\nx",
        "projects/demo/out.md": "---\ningest: no\n---\nx",
        "projects/demo/odd.md": "---\ningest: [1]\n---\nx",
        "projects/demo/sdk.md": "---\ntype: session\norigin: sdk-py\n---\nx",
        "classes/CS1/n.md": "# Heading\ntext",
        "empty.md": "\n",
        "nothing.md": "",
        "templates/t.md": "x",
        "projects/demo/not.txt": "x",
    }
    for name, body in files.items():
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(body, encoding="utf-8")
    (tmp_path / "projects" / ".realm").write_text("projects")
    return tmp_path


def test_vault(spark, notes):
    rows = {r["path"]: r for r in vault.load(spark, str(notes), allowed=["projects"]).collect()}
    assert set(rows) == {"projects/demo/a.md", "projects/demo/b.md", "projects/demo/bad.md", "projects/demo/out.md", "projects/demo/odd.md", "projects/demo/sdk.md", "classes/CS1/n.md", "empty.md"}
    a = rows["projects/demo/a.md"]
    assert (a["external_id"], a["title"], a["collection"], a["realm"], a["skip_reason"]) == ("one", "A", "demo", "projects", None)
    assert json.loads(a["metadata"]) == {"id": "one", "tags": ["x", "y"], "title": "A", "when": "2026-01-02"}
    assert rows["projects/demo/b.md"]["skip_reason"] == "id is taken by projects/demo/a.md"
    assert rows["projects/demo/bad.md"]["skip_reason"].startswith("malformed")
    assert rows["projects/demo/out.md"]["skip_reason"] == "opted out" and "must be" in rows["projects/demo/odd.md"]["skip_reason"]
    assert rows["classes/CS1/n.md"]["title"] == "Heading" and rows["classes/CS1/n.md"]["collection"] == "CS1" and rows["classes/CS1/n.md"]["realm"] is None
    assert rows["empty.md"]["skip_reason"] == "empty body"
    assert vault.load(spark, str(notes), notes=["classes/CS1/n.md", "classes/CS1/n.md"], allowed=["projects"]).count() == 1
    with pytest.raises(ValueError):
        vault.scan(spark, str(notes), ["../x.md"])
    with pytest.raises(ValueError):
        vault.discover_realms(str(notes), allowed=[])


def test_export(spark, tmp_path):
    put = lambda name, rows: (tmp_path / name).write_text(json.dumps(rows))
    put("observations.json", [{"id": 1, "memory_session_id": "m", "narrative": "N", "facts": '["f"]', "concepts": "bad", "project": "p"}, {"id": 2, "text": " "}])
    put("summaries.json", [{"id": 1, "request": "R", "learned": "L", "project": "p"}, {"id": 2}])
    put("prompts.json", [{"id": 1, "prompt_text": "x" * 90}, {"id": 2, "prompt_text": "short"}])
    put("sessions.json", [{"id": 2, "memory_session_id": "m", "project": "late"}, {"id": 1, "memory_session_id": "m", "project": "early"}])
    rows = {r["external_id"]: r for r in exports.load_export(spark, str(tmp_path)).collect()}
    assert {k: r["skip_reason"] for k, r in rows.items()} == {"1": None, "2": "empty observation", "summary:1": None, "summary:2": "empty summary", "prompt:1": None, "prompt:2": "short prompt"}
    assert rows["summary:1"]["body"] == "## Request\n\nR\n\n## Learned\n\nL" and rows["summary:1"]["title"] == "[p] R"
    meta = json.loads(rows["1"]["metadata"])
    assert meta["facts"] == ["f"] and meta["concepts"] == [] and meta["session"]["project"] == "early"
    with pytest.raises(ValueError):
        exports.load_export(spark, str(tmp_path / "none"))


def test_materials_and_transcripts(spark, tmp_path):
    unit = [{"unit_no": 2, "unit_kind": "page", "text": "b"}, {"unit_no": 1, "unit_kind": "page", "text": "a"}]
    rows = [(1, "My File.PDF", "CS 101", "extracted", None, unit), (2, "x", "CS 101", None, 1, unit), (3, "x", "CS 101", "failed", None, unit), (4, "x", "CS 101", None, None, []), (5, "x", " ", None, None, unit), (6, "x", "??", None, None, unit)]
    df = spark.createDataFrame(rows, "id int, file_name string, course_id string, text_status string, superseded_by int, units array<struct<unit_no: int, unit_kind: string, text: string>>")
    got = {r["external_id"]: r for r in exports.plan_materials(df).collect()}
    assert got["material-file-1"]["path"] == "classes/cs101/materials/my-file-1.md" and got["material-file-1"]["body"].index("Page 1") < got["material-file-1"]["body"].index("Page 2")
    assert [got[f"material-file-{k}"]["skip_reason"] for k in range(2, 7)] == ["superseded by material-file-1", "text_status is failed", "no text units", "no course id yet", "unknown form of course id"]
    (tmp_path / "t.jsonl").write_text('{"type":"user","uuid":"u","message":{"role":"user"}}\nnot json\n{"type":\n')
    assert [r["uuid"] for r in exports.scan_transcripts(spark, str(tmp_path / "t.jsonl")).collect()] == ["u"]


def test_git(spark):
    log = "\x1eaaa\x1f2026-01-02T00:00:00Z\x1ffeat(x): one\x1f\x1f\nsrc/a.py\x00src/b.py\x00\x1ebbb\x1f2026-01-03T00:00:00Z\x1fplain\x1fBREAKING CHANGE: y\x1f\x1eaaa\x1f2026-01-02T00:00:00Z\x1ffeat(x): one\x1f\x1f\nsrc/a.py\x00src/b.py\x00"
    commits = git.parse_log(spark.createDataFrame([(log,)], "log string"))
    rows = {r["sha"]: r for r in git.mark_main(commits, spark.createDataFrame([("aaa",)], "sha string")).collect()}
    assert rows["aaa"]["files"] == ["src/a.py", "src/b.py"] and rows["aaa"]["scope"] == "x" and rows["aaa"]["on_main"] and rows["bbb"]["breaking"] and not rows["bbb"]["on_main"]
    assert git.touched_files(commits).count() == 2
    t = datetime(2026, 1, 1)
    sessions = spark.createDataFrame([("s", "r", t, t + timedelta(hours=5))], "session_id string, repo string, started_at timestamp, ended_at timestamp")
    pulls = spark.createDataFrame([("r", 1, t - timedelta(1), t + timedelta(hours=1), None), ("r", 2, t - timedelta(1), None, None), ("q", 3, t, t, t)], "repo string, number int, created_at timestamp, merged_at timestamp, closed_at timestamp")
    assert [r["number"] for r in git.pull_requests_in(sessions, pulls).collect()] == [1]


PLAN = """# Plan
## Phase 1
### R-1 First thing
- Done when: it works
  and more
- [x] do it
  fully
```
### R-9 not this
- [ ] nor this
```
### R-2 Second
- [ ] later

| Phase | State |
| --- | --- |
| 1 | open |
"""


def test_plans(spark):
    rows = plandocs.parse(PLAN, "p.md")
    assert [(r["name"], r["owner"]) for r in rows if r["kind"] == "requirement"] == [("R-1", "Phase 1"), ("R-2", "Phase 1")]
    assert [(r["owner"], r["text"], r["checked"]) for r in rows if r["kind"] == "checkbox"] == [("R-1", "do it fully", True), ("R-2", "later", False)]
    assert [r["text"] for r in rows if r["kind"] == "field"] == ["it works and more"]
    assert [r["name"] for r in rows if r["kind"] == "phase"] == ["1"]
    assert plandocs.parse("- [ ] a", "x/50_PHASE7_polish.md")[0]["name"] == "PHASE7"
    docs = spark.createDataFrame([("a", PLAN), ("b", "### R-1 Other name"), ("c", None)], "source string, text string")
    assert plandocs.id_collisions(plandocs.parse_documents(docs)).count() == 1


def test_store_is_idempotent(spark, tmp_path):
    store = Store(spark, tmp_path.as_uri())
    with pytest.raises(LookupError):
        store.read("documents")
    incoming = spark.createDataFrame([("o", "a", "h1", "T", "c", "{}", 1), ("o", "b", "h2", None, " ", "{}", 0)], "source string, external_id string, content_hash string, title string, collection string, metadata string, n_chunks int")
    columns = ["content_hash", "title", "collection", "metadata"]
    at = F.lit("2026-01-01 00:00:00").cast("timestamp")
    actions = lambda df: {r["external_id"]: r["action"] for r in df.collect()}
    assert actions(store.upsert_documents(incoming, columns=columns, at=at, dry_run=True)) == {"a": "would-insert", "b": "failed"}
    assert not store.exists("documents")
    assert actions(store.upsert_documents(incoming, columns=columns, at=at)) == {"a": "inserted", "b": "failed"}
    good = incoming.filter("external_id = 'a'")
    assert actions(store.upsert_documents(good, columns=columns, at=at)) == {"a": "unchanged"}
    moved = good.withColumn("collection", F.lit("d"))
    assert actions(store.upsert_documents(moved, columns=columns, at=at)) == {"a": "metadata-updated"}
    assert store.read("documents").first()["collection"] == "d"
    rows = spark.createDataFrame([(1, None), (1, None), (2, "x")], "k int, v string")
    assert store.insert_if_absent("t", rows, ["k", "v"]).count() == 2
    assert store.insert_if_absent("t", rows, ["k", "v"]).count() == 0
    assert not ingest.may_prune(limited=False, failures=1, documents=3) and ingest.may_prune(limited=False, failures=0, documents=3)


def test_fold_any_order(spark):
    day = datetime(2026, 1, 1)
    log = [("i", day, "found", "a", "open"), ("i", day + timedelta(1), "claim-fixed", "b", "claimed-fixed"), ("i", day + timedelta(2), "merged-pr", "c", "verified"), ("i", day + timedelta(3), "found", "d", "open"), ("i", day + timedelta(3), "note", "e", None)]
    schema = "issue_id string, effective_at timestamp_ntz, event_kind string, cause_ref string, to_state string"
    seen = set()
    for seed in range(3):
        random.Random(seed).shuffle(log)
        (row,) = curate.fold_issues(spark.createDataFrame(log, schema)).collect()
        seen.add(tuple(row))
    assert seen == {("i", "regressed", 2, 5, 2, day + timedelta(3), None)}


def test_promotion(spark):
    def mode(*rounds):
        rows = [("prune", date_no, 2, a, r, 2 - a - r, True) for date_no, (a, r) in enumerate(rounds)]
        (row,) = curate.promotion(spark.createDataFrame(rows, "action string, report_day int, proposed long, accepted long, rejected long, undecided long, all_no_loss boolean")).collect()
        return row["mode"], row["streak"]

    good = (2, 0)
    assert mode(good, good, good) == ("automatic", 3)
    assert mode(good, good, good, (1, 1)) == ("proposals", 0)
    assert mode(good, good, good, (1, 0)) == ("automatic", 3)


def test_apportion_and_paths(spark):
    w = spark.createDataFrame([("g", k, 1) for k in range(3)] + [("z", k, 0) for k in range(2)], "g string, k int, w long")
    got = {(r["g"], r["k"]): r["share"] for r in curate.apportion(w, group="g", order="k", weight="w", total=10).collect()}
    assert got == {("g", 0): 4, ("g", 1): 3, ("g", 2): 3, ("z", 0): 5, ("z", 1): 5}
    a = spark.createDataFrame([("store.py",), ("./x//restore.py",)], "p string")
    b = spark.createDataFrame([("ingest/store.py",), ("restore.py",), ("store.py",)], "q string")
    got = {(r["p"], r["q"]) for r in curate.join_by_suffix(a, b, left_path="p", right_path="q").collect()}
    assert got == {("store.py", "ingest/store.py"), ("store.py", "store.py"), ("./x//restore.py", "restore.py")}


def test_checkboxes_and_proposals(spark):
    reports_ = spark.createDataFrame([("d", "- [x] prune: n1\n- [ ] prune: n1\n- [X] condense: n2\n* [x] prune: n3\n- [x] prune: n4 extra")], "report_day string, text string")
    assert {(r["action"], r["note_id"]): r["checked"] for r in curate.checkboxes(reports_).collect()} == {("prune", "n1"): True, ("condense", "n2"): True}
    assert curate.fingerprint("v", {"a": 1}) != curate.fingerprint("v", {"a": 2})


def test_tokens_and_histogram(spark):
    df = spark.createDataFrame([("claude-mem:summary:12@0.7712",), ("obsidian:notes/me@home.md",), ("nocolon",), ("a:@1",), (None,)], "t string")
    got = [tuple(r) for r in df.select(*[v.alias(k) for k, v in reports.token_parts(F.col("t")).items()]).collect()]
    assert got == [("claude-mem", "summary:12", 0.7712), ("obsidian", "notes/me@home.md", None), (None, None, None), (None, None, None), (None, None, None)]
    events = spark.createDataFrame([(s, 1) for s in (0.49999, 0.5, 0.55, 0.9999999999, 1.0, None)], "similarity double, rank int")
    counts = {r["bucket"]: r["n_results"] for r in reports.similarity_histogram(events).collect()}
    assert {k: v for k, v in counts.items() if v} == {"<0.50": 1, "0.50": 1, "0.55": 1, "0.95": 2, "n/a": 1} and len(counts) == 12
    now = datetime(2026, 1, 10)
    assert reports.since_bound("3d", now) == datetime(2026, 1, 7) and reports.since_bound(None, now) is None
    with pytest.raises(ValueError):
        reports.since_bound("soon", now)
    page = reports.dashboard({"t": [{"a": "<x>"}], "e": []}, generated_at=now)
    assert "&lt;x&gt;" in page and "none" in page


def test_audits(spark):
    chunks = spark.createDataFrame([("d", 0, 0, [1.0, 0.0], "a b", 2), ("d", 1, 1, [0.5, 0.0], "a", 9), ("e", 2, 1, None, "x", 1)], "document_id string, chunk_id int, chunk_index int, embedding array<float>, content string, token_count int")
    assert [r["document_id"] for r in audit.chunk_indexes(chunks).collect()] == ["e"]
    assert sorted(r["detail"] for r in audit.norms(chunks).collect()) == ["1 0.5", "2 none"]
    assert [r["detail"] for r in audit.token_counts(chunks).collect()] == ["1 9 1"]
    t = datetime(2026, 1, 1)
    a = spark.createDataFrame([("x", "1"), ("y", "1")], "external_id string, content_hash string")
    b = spark.createDataFrame([("y", "2", t), ("z", "1", t), ("w", "1", t + timedelta(9))], "external_id string, content_hash string, updated_at timestamp")
    got = {r["document_id"]: r["detail"] for r in audit.vault(a, b, fresh_since=F.lit(t + timedelta(1))).collect()}
    assert got == {"x": "missing", "y": "differs", "z": "orphan"}
    assert audit.sample(chunks, "chunk_id", 2, 7).count() == 2 and audit.sample(chunks, "chunk_id", 9, 7).count() == 3


def test_evaluation(spark):
    cases = spark.createDataFrame([(1, None, "c", ["a"], [], False), (2, "r", "c", [], ["Needle"], False), (3, None, "c", [], [], True)], "case_id int, realm string, collection string, expect array<string>, expect_contains array<string>, negative boolean")
    hits = spark.createDataFrame([(1, 4, "a", "", ""), (2, 1, "q", "", "a needle here")], "case_id int, rank int, external_id string, title string, content string")
    found = evaluate.first_hits(cases, hits)
    assert tuple(evaluate.scores(found).first()) == (0.5, 0.625, 1.0)
    assert tuple(evaluate.scores(found.limit(0)).first()) == (1.0, 1.0, 1.0)
    assert {r["realm"] for r in evaluate.by_collection(found).collect()} == {"-", "r"}


def test_store_writes_chunks_with_documents(spark, tmp_path):
    """Chunks and documents change in one move; a change of metadata leaves chunks; no chunks is a failure."""
    store = Store(spark, tmp_path.as_uri())
    shape = "source string, external_id string, content_hash string, title string, collection string, metadata string"
    docs = lambda *rows: spark.createDataFrame([("o", *r) for r in rows], shape)
    parts = lambda *rows: spark.createDataFrame([("o", *r, None, None) for r in rows], "source string, external_id string, chunk_index int, content string, token_count int, embedding array<float>")
    options = {"columns": ["content_hash", "title", "collection", "metadata"], "at": F.lit("2026-01-01 00:00:00").cast("timestamp")}
    actions = lambda df: {r["external_id"]: (r["action"], r["n_chunks"]) for r in df.collect()}
    held = lambda: sorted((r["external_id"], r["chunk_index"], r["lexemes"]) for r in store.read("chunks").collect())
    first = docs(("a", "h1", "T", "c", "{}"), ("b", "h2", "U", "c", "{}"), ("e", "h3", "V", "c", "{}"))
    assert actions(store.upsert_documents(first, chunks=parts(("a", 0, "running dogs"), ("a", 1, None), ("b", 0, "cats")), **options)) == {"a": ("inserted", 2), "b": ("inserted", 1), "e": ("failed", 0)}
    assert held() == [("a", 0, ["run", "dog"]), ("a", 1, None), ("b", 0, ["cat"])] and store.read("documents").count() == 2
    again = docs(("a", "h9", "T", "c", "{}"), ("b", "h2", "U", "moved", "{}"))
    assert actions(store.upsert_documents(again, chunks=parts(("a", 0, "parsers"), ("b", 0, "ignored")), **options)) == {"a": ("updated", 1), "b": ("metadata-updated", 1)}
    assert held() == [("a", 0, ["parser"]), ("b", 0, ["cat"])]
    assert store.update_metadata(docs(("b", "", "New", "", "")), ["title"], at=options["at"]) == 1
    with pytest.raises(LookupError):
        store.update_metadata(docs(("zz", "", "New", "", "")), ["title"], at=options["at"])
    assert {r["external_id"]: r["title"] for r in store.read("documents").collect()} == {"a": "T", "b": "New"}
    store.delete_documents(docs(("a", "", "", "", "")))
    assert held() == [("b", 0, ["cat"])] and store.read("documents").count() == 1
    assert len(list((tmp_path / "chunks").iterdir())) == 2  # the current snapshot and the one before


def test_searching_a_store(spark, tmp_path):
    """English search over stored lexemes: phrase, alternative, exclusion, and denser matches first."""
    from tarnwork.operators.search import search

    texts = ["the query planner plans", "planner of a query", "query planners and tomatoes", "a parser", "planner far away from any query at all", None]
    store = Store(spark, tmp_path.as_uri())
    docs = spark.createDataFrame([(f"d{k}", "o", "c", f"d{k}", f"T{k}", "{}") for k in range(6)], "document_id string, source string, collection string, external_id string, title string, metadata string")
    parts = spark.createDataFrame([(k, f"d{k}", t, None) for k, t in enumerate(texts)], "chunk_id long, document_id string, content string, embedding array<float>")
    store.put_searchable(docs, parts)
    found = lambda q, **o: [r["chunk_id"] for r in search(store.read("documents"), store.read("chunks"), query_text=q, linked=True, **o).collect()]
    assert found('"query planner"') == [0, 2] and set(found('"query planner" or parsers -tomatoes')) == {0, 2, 3}  # minus binds to its alternative
    assert set(found("planner -tomatoes")) == {0, 1, 4}
    assert found("query planner")[-1] == 4 and found("the") == [] and found("parsing") == []
    assert found("parsers", filter_collection="x") == [] and found("parsers", filter_collection="c") == [3]
