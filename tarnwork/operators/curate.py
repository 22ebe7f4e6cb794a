"""Reducers over notes, issues and proposals: folds, joins by path, prefix and interval, scores and packing.

Folds run as ordered aggregates inside the JVM. Joins that the rules state as inequalities are turned into
equi-joins on exploded keys (suffixes, prefixes, days), so that no pair is made that doesn't share a key.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnwork.functions.text import normal_path
from tarnwork.operators.hierarchy import contract
from tarnwork.operators.ranking import number_rows
from tarnwork.operators.scoped import ROW_BYTES, split_by_size
from tarnwork.runtime import cut_lineage, ship

# Order of kinds on the same instant, and of states of one cause.
KIND_ORDER = ["found", "recurrence", "claim-workaround", "claim-wontfix", "claim-fixed", "fix-commit", "merged-pr"]
STATE_ORDER = {"open": 1, "regressed": 1, "claimed-fixed": 2, "verified": 3}

# Weights of a note's features in its impact, and the half-lives of relevance in days.
WEIGHTS = {"commits": 1.2, "prs": 1.5, "decisions": 1.0, "issues_found": 0.8, "issues_fixed": 1.2, "requirement_refs": 0.4, "citations": 1.0, "retrievals": 0.6, "used": 1.0, "children": 0.3}
HALF_LIFE = {"project": 90.0, "class": 42.0}


def fold_issues(events: DataFrame) -> DataFrame:
    """State of every issue after replaying its events in order, whatever order they came in.

    `events`: `issue_id, effective_at, event_kind, cause_ref, to_state`. A sighting opens or reopens, a claim
    of a fix closes an open issue provisionally, a verification closes it; null states note something. Columns:
    `issue_id, state, sightings, n_events, n_intervals, open_since, closed_at` of the last interval.

    Replay is a chain of maps between few states, so each day of an issue is folded on its own, once from every
    state it may begin in, and the days' maps are applied in turn: no task sees more than an issue's day or its
    list of days.
    """
    kinds = F.array(*map(F.lit, KIND_ORDER))
    kind = F.coalesce(F.nullif(F.array_position(kinds, F.col("event_kind")), F.lit(0)), F.lit(len(KIND_ORDER) + 1))
    weight = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for p in STATE_ORDER.items() for x in p]), F.coalesce("to_state", F.lit(""))), F.when(F.col("to_state").isNull(), 0).otherwise(4))
    log = F.array_sort(F.collect_list(F.struct(F.col("effective_at").alias("at"), kind.alias("kind"), F.col("cause_ref").alias("ref"), weight.alias("weight"), F.col("to_state").alias("claim"))))
    days = events.groupBy("issue_id", F.to_date("effective_at").alias("day")).agg(log.alias("log"))
    maps = days.select("issue_id", "day", F.array(*[F.aggregate("log", _start(s), _apply) for s in _STATES]).alias("ends"))
    chained = maps.groupBy("issue_id").agg(F.array_sort(F.collect_list(F.struct("day", "ends"))).alias("days"))
    return chained.select("issue_id", F.aggregate("days", _start(None), _chain).alias("s")).select("issue_id", *[F.col(f"s.{c}").alias(c) for c in ("state", "sightings", "n_events", "n_intervals", "open_since", "closed_at")])


_STATES = [None, "open", "claimed-fixed", "verified", "regressed"]


def _start(state: str | None) -> Column:
    """Nothing replayed yet, in a given state; only `verified` has no open interval among the named ones."""
    zero, none = F.lit(0).cast("bigint"), F.lit(None).cast("timestamp_ntz")
    return F.struct(F.lit(state).cast("string").alias("state"), F.lit(state in ("open", "claimed-fixed", "regressed")).alias("is_open"), zero.alias("sightings"), zero.alias("n_events"), zero.alias("n_intervals"), none.alias("open_since"), none.alias("closed_at"), F.lit(False).alias("touched"))


def _apply(s: Column, e: Column) -> Column:
    claim, state = e["claim"], s["state"]
    sighting = claim.isin("open", "regressed")
    active = F.coalesce(state.isin("open", "regressed"), F.lit(False))
    proven = F.coalesce(state == "verified", F.lit(False))
    after = F.when(sighting & state.isNull(), "open").when(sighting & ~active, "regressed").when((claim == "claimed-fixed") & (state.isNull() | active), "claimed-fixed").when(claim == "verified", "verified").otherwise(state)
    opens = F.coalesce((sighting & ~active & ~s["is_open"]) | ((claim == "claimed-fixed") & state.isNull()) | ((claim == "verified") & ~proven & ~s["is_open"]), F.lit(False))
    closes = F.coalesce((claim == "verified") & ~proven, F.lit(False))
    return F.struct(
        after.alias("state"),
        ((s["is_open"] | opens) & ~closes).alias("is_open"),
        (s["sightings"] + F.when(F.coalesce(sighting, F.lit(False)), 1).otherwise(0)).alias("sightings"),
        (s["n_events"] + 1).alias("n_events"),
        (s["n_intervals"] + opens.cast("bigint")).alias("n_intervals"),
        F.when(opens, e["at"]).otherwise(s["open_since"]).alias("open_since"),
        F.when(closes, e["at"]).when(opens, F.lit(None).cast("timestamp_ntz")).otherwise(s["closed_at"]).alias("closed_at"),
        (s["touched"] | opens | closes).alias("touched"),
    )


def _chain(s: Column, d: Column) -> Column:
    """What was replayed so far, and a day begun in the state it ended in."""
    place = F.when(s["state"].isNull(), 1).otherwise(F.array_position(F.array(*[F.lit(x or "") for x in _STATES]), s["state"]).cast("int"))
    e = F.element_at(d["ends"], place)
    return F.struct(
        e["state"].alias("state"), e["is_open"].alias("is_open"), (s["sightings"] + e["sightings"]).alias("sightings"), (s["n_events"] + e["n_events"]).alias("n_events"), (s["n_intervals"] + e["n_intervals"]).alias("n_intervals"),
        F.coalesce(e["open_since"], s["open_since"]).alias("open_since"), F.when(e["touched"], e["closed_at"]).otherwise(s["closed_at"]).alias("closed_at"), (s["touched"] | e["touched"]).alias("touched"),
    )


def promotion(rounds: DataFrame, *, needed: int = 3, acceptance: float = 0.95) -> DataFrame:
    """Mode and streak of each action after replaying its rounds by day.

    `rounds`: `action, report_day, proposed, accepted, rejected, undecided, all_no_loss`. A trailing round with
    undecided items is left out; enough qualifying rounds in a row make an action automatic, a rejection demotes.
    """
    qualifies = (F.col("undecided") == 0) & (F.col("accepted") >= acceptance * F.col("proposed")) & F.col("all_no_loss")
    log = F.array_sort(F.collect_list(F.struct("report_day", (F.col("rejected") > 0).alias("rejected"), qualifies.alias("qualifies"), (F.col("undecided") > 0).alias("pending"))))
    counted = F.when(F.element_at("log", -1)["pending"], F.slice("log", 1, F.size("log") - 1)).otherwise(F.col("log"))

    def step(s: Column, r: Column) -> Column:
        demoted = (s["mode"] == "automatic") & r["rejected"]
        streak = F.when(demoted, 0).when(r["qualifies"], s["streak"] + 1).otherwise(0)
        mode = F.when(demoted, "proposals").when(r["qualifies"] & (s["streak"] + 1 >= needed), "automatic").otherwise(s["mode"])
        return F.struct(mode.alias("mode"), streak.alias("streak"))

    start = F.struct(F.lit("proposals").alias("mode"), F.lit(0).alias("streak"))
    return rounds.groupBy("action").agg(log.alias("log")).select("action", F.aggregate(counted, start, step).alias("s")).select("action", "s.*")


def rounds_of(proposals: DataFrame, decisions: DataFrame) -> DataFrame:
    """Proposals by day and action with what was decided last: `report_day, action, note_id, no_loss` against
    `report_day, action, note_id, accepted, id`."""
    key = ["report_day", "action", "note_id"]
    last = decisions.groupBy(*key).agg(F.max_by("accepted", "id").alias("accepted"))
    joined = proposals.join(last, key, "left")
    return joined.groupBy("report_day", "action").agg(F.count("*").alias("proposed"), F.count_if("accepted").alias("accepted"), F.count_if(~F.col("accepted")).alias("rejected"), F.count_if(F.col("accepted").isNull()).alias("undecided"), F.bool_and("no_loss").alias("all_no_loss"))


def impact(weights: dict[str, float] | None = None, cap: float = 10.0) -> Column:
    """Weighted sum of the logarithms of the feature columns, capped."""
    out = F.lit(0.0)
    for name, weight in (weights or WEIGHTS).items():
        out = out + weight * F.log1p(F.coalesce(F.col(name), F.lit(0)).cast("double"))
    return F.least(F.lit(cap), out)


def disagrees(activity: Column, knowledge: Column, usage: Column, least: tuple[int, int, int] = (3, 3, 5)) -> Column:
    """Whether one kind of signal is strong and the others are silent."""
    return ((activity >= least[0]) & (knowledge == 0)) | ((knowledge >= least[1]) & (activity == 0)) | ((usage >= least[2]) & (activity + knowledge == 0))


def relevance(similar: Column, recent: Column, in_open_issue: Column, weights: tuple[float, float, float] = (0.5, 0.3, 0.2)) -> Column:
    out = weights[0] * F.greatest(similar, F.lit(0.0)) + weights[1] * recent + weights[2] * in_open_issue.cast("double")
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), out))


def path_suffixes(path: Column) -> Column:
    """All suffixes of a path by whole segments, the path itself included."""
    parts = F.split(normal_path(path), "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "/"))


def join_by_suffix(left: DataFrame, right: DataFrame, *, left_path: str, right_path: str) -> DataFrame:
    """Pairs of rows one of whose paths ends with the other's segments: each side is joined to the other's
    suffixes, so only rows that share a whole suffix meet."""
    a = left.withColumn("left_full", normal_path(F.col(left_path)))
    b = right.withColumn("right_full", normal_path(F.col(right_path)))
    longer_right = a.join(b.withColumn("suffix", F.explode(path_suffixes(F.col(right_path)))), F.col("left_full") == F.col("suffix"))
    longer_left = a.withColumn("suffix", F.explode(path_suffixes(F.col(left_path)))).join(b, F.col("suffix") == F.col("right_full")).filter("left_full != right_full")
    return longer_right.drop("suffix", "left_full", "right_full").unionByName(longer_left.drop("suffix", "left_full", "right_full"))


def resolve_prefixes(prefixes: DataFrame, commits: DataFrame, *, least: int = 7) -> DataFrame:
    """The one commit that each sha prefix of at least `least` characters names, null when none or several.
    Joined on the first `least` characters."""
    asked = prefixes.select("prefix").distinct().withColumn("head", F.substring(F.lower("prefix"), 1, least))
    pairs = asked.filter(F.length("prefix") >= least).join(commits.select("sha", F.substring("sha", 1, least).alias("head")), "head").filter(F.col("sha").startswith(F.lower("prefix")))
    found = pairs.groupBy("prefix").agg(F.when(F.count_distinct("sha") == 1, F.min("sha")).alias("sha"))
    return asked.select("prefix").join(found, "prefix", "left")


def events_in_windows(windows: DataFrame, events: DataFrame, *, start: str, end: str, at: str, key: str) -> DataFrame:
    """Events that fall into windows of the same key, both ends included. Windows are spread over the days they
    touch, so that the join is on key and day."""
    days = windows.withColumn("day", F.explode(F.sequence(F.to_date(start), F.to_date(end), F.expr("INTERVAL 1 DAY"))))
    dated = events.withColumn("day", F.to_date(at))
    return days.join(dated, [key, "day"]).filter((F.col(at) >= F.col(start)) & (F.col(at) <= F.col(end))).drop("day")


def cited(notes: DataFrame, *, least: int = 8) -> DataFrame:
    """How many later notes name each note's id as a whole token (`note_id, at, body`). Bodies are cut into
    tokens once and joined on them; ids under `least` characters count only inside a wikilink."""
    ids = notes.select(F.col("note_id").alias("cited_id"), F.col("at").alias("cited_at"))
    whole = F.transform(F.regexp_extract_all("body", F.lit("[A-Za-z0-9_-]{8,}"), F.lit(0)), lambda t: F.struct(t.alias("token"), F.lit(False).alias("linked")))
    links = F.transform(F.regexp_extract_all("body", F.lit(r"\[\[([^\]|#]+)"), F.lit(1)), lambda t: F.struct(F.element_at(F.split(t, "/"), -1).alias("token"), F.lit(True).alias("linked")))
    tokens = notes.filter("body IS NOT NULL").select("note_id", "at", F.explode(F.array_distinct(F.concat(whole, links))).alias("t")).select("note_id", "at", "t.*")
    named = tokens.join(ids, F.col("token") == F.col("cited_id")).filter(F.col("linked") | (F.length("cited_id") >= least)).filter("at > cited_at AND note_id != cited_id")
    counts = named.groupBy("cited_id").agg(F.count_distinct("note_id").alias("n"))
    return ids.join(counts, "cited_id", "left").select(F.col("cited_id").alias("note_id"), F.coalesce("n", F.lit(0)).alias("citations"))


def mentions(texts: DataFrame, ids: DataFrame, *, text: str, pattern: str) -> DataFrame:
    """Rows of `texts` with each known id (`id`) that they name as a whole token over `[A-Za-z0-9-]`."""
    found = texts.withColumn("id", F.explode(F.array_distinct(F.filter(F.regexp_extract_all(F.col(text), F.lit("[A-Za-z0-9-]+"), F.lit(0)), lambda t: t.rlike(f"^(?:{pattern})$")))))
    return found.join(ids.select("id").distinct(), "id")


#: A fold in order copies its result at every step, so it is kept to groups of some two thousand items.
PACK_BYTES = 2000 * ROW_BYTES


def pack_in_order(items: DataFrame, *, group: str, order: list[str], size: str, most: int = 8, limit: int = 12_000, scope: int = PACK_BYTES) -> DataFrame:
    """Batches of a group's items in order: a batch closes when it holds `most` items or the next would exceed
    `limit`. Columns: the group, `place`, the order columns, `batch_no`.

    Groups of at most `scope` bytes (some two thousand items) are folded. In a larger one each item points to where a batch that began at it
    would end, at most `most` rows on; batches begin at the items on the path of pointers from the first one,
    which tree contraction finds."""
    small, large = split_by_size(items.select(group, *order, F.coalesce(size, F.lit(0)).cast("bigint").alias("size")), group, scope)
    out = _pack_small(small, group, order, most, limit)
    return out if large is None else out.unionByName(_pack_large(large, group, order, most, limit))


def _pack_small(items: DataFrame, group: str, order: list[str], most: int, limit: int) -> DataFrame:
    listed = F.array_sort(F.collect_list(F.struct(*order, "size")))

    def step(s: Column, x: Column) -> Column:
        full = (s["count"] > 0) & ((s["count"] >= most) | (s["used"] + x["size"] > limit))
        batch = s["batch"] + full.cast("int")
        return F.struct(batch.alias("batch"), F.when(full, 1).otherwise(s["count"] + 1).alias("count"), F.when(full, x["size"]).otherwise(s["used"] + x["size"]).alias("used"), F.concat(s["out"], F.array(batch)).alias("out"))

    start = F.struct(F.lit(1).alias("batch"), F.lit(0).alias("count"), F.lit(0).cast("bigint").alias("used"), F.array().cast("array<int>").alias("out"))
    folded = items.groupBy(group).agg(listed.alias("items")).select(group, "items", F.aggregate("items", start, step)["out"].alias("batches"))
    zipped = folded.select(group, F.posexplode(F.arrays_zip("items", "batches")).alias("place", "z"))
    return zipped.select(group, (F.col("place") + 1).cast("bigint").alias("place"), *[F.col(f"z.items.{c}").alias(c) for c in order], F.col("z.batches").cast("bigint").alias("batch_no"))


def _pack_large(items: DataFrame, group: str, order: list[str], most: int, limit: int) -> DataFrame:
    rows = cut_lineage(number_rows(items, group=[group], order=order).withColumn("node", F.concat_ws("\x1f", group, "place")), "numbered")
    # Each item meets the `most` items from itself on; the first that no longer fits is where the next batch begins.
    ahead = rows.select(F.explode(F.transform(F.sequence(F.lit(0), F.lit(most)), lambda k: F.concat_ws("\x1f", F.col(group), F.col("place") - k))).alias("head"), "place", "size", "node")
    nearby = ahead.groupBy("head").agg(F.array_sort(F.collect_list(F.struct("place", "size", "node"))).alias("run"))

    def step(s: Column, x: Column) -> Column:
        fits = s["next"].isNull() & ((s["count"] == 0) | ((s["count"] < most) & (s["used"] + x["size"] <= limit)))
        return F.struct((s["count"] + fits.cast("int")).alias("count"), (s["used"] + F.when(fits, x["size"]).otherwise(0)).alias("used"), F.when(s["next"].isNull() & ~fits, x["node"]).otherwise(s["next"]).alias("next"))

    start = F.struct(F.lit(0).alias("count"), F.lit(0).cast("bigint").alias("used"), F.lit(None).cast("string").alias("next"))
    pointed = rows.select("node", "place").join(nearby, F.col("node") == F.col("head")).select("node", F.aggregate("run", start, step)["next"].alias("parent"), F.when(F.col("place") == 1, 1).otherwise(0).alias("value"))
    begins = contract(pointed, paths=False, fold="max").select(F.col("node").alias("begin"), F.col("folded").alias("begins"))
    marked = rows.join(begins, F.col("node") == F.col("begin")).select(group, "place", *order, "begins")
    return number_rows(marked, group=[group], order=["place"], place="again", sums={"batch_no": "begins"}).select(group, "place", *order, "batch_no")


def apportion(weights: DataFrame, *, group: str, order: str, weight: str, total: int) -> DataFrame:
    """`total` shared out among a group's rows by largest remainder; ties to the earlier row, all-zero weights
    evenly."""
    totals = weights.groupBy(F.col(group).alias("group_of")).agg(F.sum(F.col(weight).cast("decimal(38,0)")).alias("sum_of"), F.count("*").alias("rows_of"))
    joined = weights.join(totals, F.col(group) == F.col("group_of"))
    shared = joined.withColumn("even", F.when(F.col("sum_of") > 0, F.col(weight)).otherwise(1).cast("decimal(38,0)")).withColumn("whole", F.when(F.col("sum_of") > 0, F.col("sum_of")).otherwise(F.col("rows_of").cast("decimal(38,0)")))
    parts = shared.withColumn("base", F.expr(f"CAST(({total} * even) div whole AS bigint)")).withColumn("rest", F.expr(f"({total} * even) % whole"))
    given = parts.groupBy(F.col(group).alias("given_of")).agg((F.lit(total) - F.sum("base")).alias("spare"))
    placed = number_rows(parts, group=[group], order=[F.desc("rest"), F.col(order)]).join(given, F.col(group) == F.col("given_of"))
    return placed.withColumn("share", F.col("base") + (F.col("place") <= F.col("spare")).cast("bigint")).drop("group_of", "sum_of", "rows_of", "even", "whole", "base", "rest", "given_of", "spare", "place")


def budget_prefix(sections: DataFrame, *, group: str, order: str, size: str, budget: int) -> DataFrame:
    """The leading sections of each group that fit a budget together, and what the next one may still use."""
    placed = number_rows(sections, group=[group], order=[order], sums={"used": size}).drop("place")
    return placed.withColumn("fits", F.col("used") <= budget).withColumn("room", F.greatest(F.lit(0), F.lit(budget) - (F.col("used") - F.col(size))))


def cache_plan(items: DataFrame, cache: DataFrame, key: list[str], *, size: str, largest: int) -> DataFrame:
    """Each item as `hit`, `duplicate` of an earlier item, `too-large` or `miss`, by a key of its content."""
    stored = cache.select(*key).distinct().withColumn("cached", F.lit(True))
    first = items.groupBy(*key).agg(F.min("item_id").alias("first_item"))
    plan = F.when(F.col("cached"), "hit").when(F.col("item_id") > F.col("first_item"), "duplicate").when(F.col(size) > largest, "too-large").otherwise("miss")
    return items.join(first, key).join(stored, key, "left").withColumn("plan", plan).drop("first_item", "cached")


def requirement_states(claims: DataFrame, evidence: DataFrame, requirements: DataFrame) -> DataFrame:
    """State of each requirement from claims (`id, state, at`) and evidence (`id, kind, landed, at`)."""
    c = claims.groupBy("id").agg(F.count("*").alias("n_claims"), F.count_if(F.col("state") == "done").alias("done_claims"), F.max(F.when(F.col("state") == "done", F.col("at"))).alias("done_at"), F.max(F.when(F.col("state") == "broken", F.col("at"))).alias("broken_at"))
    proof = (F.col("kind") == "plan") | ((F.col("kind") == "pr") & F.col("landed"))
    e = evidence.groupBy("id").agg(F.count("*").alias("n_evidence"), F.count_if(proof).alias("done_evidence"), F.max(F.when(proof, F.col("at"))).alias("proved_at"), F.count_if(F.col("landed") & F.col("kind").isin("commit", "pr")).alias("landings"))
    both = requirements.join(c, "id", "left").join(e, "id", "left").na.fill(0, ["n_claims", "done_claims", "n_evidence", "done_evidence", "landings"])
    done_at = F.greatest("done_at", "proved_at")
    done = (F.col("done_claims") + F.col("done_evidence")) > 0
    broken = F.col("broken_at").isNotNull() & (done_at.isNull() | (done_at < F.col("broken_at")))
    state = F.when(done & broken, "contradicted").when(done & (F.col("landings") > 0), "verified").when(done, "claimed-done").when(F.col("n_claims") + F.col("n_evidence") > 0, "in-progress").otherwise("not-started")
    return both.select("id", state.alias("state"))


def week_inputs(items: DataFrame, *, group: str, at: str, fields: list[str], version: str) -> DataFrame:
    """Items by group and Monday, with a hash of the week's items that only their content and `version` move.

    Every item is hashed by itself and the hashes are added up in four parts, so that weeks of any size are combined
    before the shuffle and the order of their items doesn't matter."""
    one = F.sha2(F.to_json(F.struct(*fields)), 256)
    parts = [F.sum(F.conv(F.substring("item_hash", k * 15 + 1, 15), 16, 10).cast("decimal(38,0)")).cast("string") for k in range(4)]
    weeks = items.select(group, F.date_trunc("week", at).cast("date").alias("week_start"), one.alias("item_hash")).groupBy(group, "week_start")
    return weeks.agg(F.count("*").alias("n_items"), F.sha2(F.concat_ws(":", F.lit(version), F.count("*"), *parts), 256).alias("input_hash"))


def fingerprint(name: str, settings: dict) -> str:
    """A version that changes with any of its settings."""
    return name + hashlib.sha256(json.dumps(settings, sort_keys=True).encode()).hexdigest()[:8]


def merge_tags(existing: Column, new: Column, previous: Column, placeholder: str = "unclassified") -> Column:
    """Existing tags without those that the last run set, and the new ones; the placeholder only alone."""
    empty = F.array().cast("array<string>")
    kept = F.array_union(F.array_except(F.coalesce(existing, empty), F.coalesce(previous, empty)), F.coalesce(new, empty))
    real = F.array_remove(kept, placeholder)
    return F.when(F.size(real) > 0, real).otherwise(F.array(F.lit(placeholder)))


def capped(values: Column, cap: int) -> Column:
    """Distinct non-blank values in order, at most `cap`."""
    return F.slice(F.array_distinct(F.filter(values, lambda x: x.isNotNull() & (x != ""))), 1, cap)


def cluster_in_order(items: DataFrame, *, group: str, threshold: float = 0.85) -> DataFrame:
    """Each item joins the earlier issue of its group with the best cosine of at least `threshold`, or opens one.

    Order matters, since issues made on the way are candidates, so a group is folded by one task; groups are
    collections and larger ones than a task's memory are to be divided by the caller. `items`: the group,
    `place` and `vector`; result: the group, `place`, `issue_place`.
    """
    import numpy as np
    import pandas as pd

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("place")
        heads: list[np.ndarray] = []
        places, out = [], []
        for place, vector in zip(pdf["place"], pdf["vector"]):
            v = np.asarray(vector, float)
            v = v / (np.linalg.norm(v) or 1.0)
            sims = np.array([h @ v for h in heads]) if heads else np.zeros(0)
            if len(sims) and sims.max() >= threshold:
                out.append(places[int(sims.argmax())])
            else:
                heads.append(v)
                places.append(place)
                out.append(place)
        return pd.DataFrame({group: pdf[group], "place": pdf["place"], "issue_place": out})

    ship(items.sparkSession)
    return items.select(group, "place", "vector").groupBy(group).applyInPandas(run, f"{group} string, place bigint, issue_place bigint")


def note_proposals(notes: DataFrame, short: int = 400) -> DataFrame:
    """`condense` for a worker's note without commits or pull requests whose items are all represented,
    `prune` for one whose features are all zero and that is a scratchpad's or short; condense wins."""
    silent = F.lit(True)
    for name in WEIGHTS:
        silent = silent & (F.coalesce(F.col(name), F.lit(0)) == 0)
    condense = F.col("parent").isNotNull() & (F.coalesce("commits", F.lit(0)) + F.coalesce("prs", F.lit(0)) == 0) & F.coalesce(F.col("all_represented"), F.lit(False))
    prune = silent & (F.col("is_scratchpad") | (F.col("body_chars") < short))
    return notes.withColumn("action", F.when(condense, "condense").when(prune, "prune")).filter("action IS NOT NULL")


def checkboxes(reports: DataFrame) -> DataFrame:
    """Ticks read back from report texts (`report_day, text`): lines `- [x] condense: <note>` or `prune`, the
    first line of each proposal."""
    lines = reports.select("report_day", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    form = r"^- \[([ xX])\] (condense|prune): (\S+)\s*$"
    ticks = lines.filter(F.col("line").rlike(form)).select("report_day", "line_no", F.regexp_extract("line", form, 2).alias("action"), F.regexp_extract("line", form, 3).alias("note_id"), (F.lower(F.regexp_extract("line", form, 1)) == "x").alias("checked"))
    return ticks.groupBy("report_day", "action", "note_id").agg(F.min_by("checked", "line_no").alias("checked"))
