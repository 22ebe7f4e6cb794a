"""Queries on search, provenance, evaluation and store audits, over the project's test tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwork.functions.jsonq import contains
from tarnwork.functions.lexical import lexemes
from tarnwork.functions.vector import cosine, nearest, nearest_of_all
from tarnwork.operators import audit, evaluate, reports
from tarnwork.operators.search import fuse, get_document, list_collections, not_superseded, search
from tarnwork.runtime import shared_folder, table
from tarnwork.sources.store import Store

QUERY_TEXT = "the query planner"
MATCH, FLOOR = 10, 0.2

# Notes are documents, their blocks chunks; a block's vector is the one of the same number, where there is one.
_DOCS = """
  note AS (SELECT note_id, min(collection_key) AS collection, min(captured_at) AS updated_at, count(*) AS n_blocks FROM note_blocks GROUP BY note_id),
  docs AS (SELECT note_id AS document_id, 'obsidian' AS source, collection, note_id AS external_id, note_id AS title,
    CASE WHEN n_blocks % 7 = 0 THEN 'superseded' ELSE 'active' END AS status, CAST(n_blocks % 5 AS BIGINT) AS size_class, updated_at FROM note),
  chunks AS (SELECT b.block_id AS chunk_id, b.note_id AS document_id, b.block_index AS chunk_index, b.block_text AS content, b.unit_tokens AS token_count, e.embedding
    FROM note_blocks b LEFT JOIN embeddings e ON e.vec_id = b.block_id),
  q AS (SELECT embedding AS qv FROM embeddings WHERE vec_id = 3)"""


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    notes = table(spark, sf_dir, "note_blocks").groupBy("note_id").agg(F.min("collection_key").alias("collection"), F.min("captured_at").alias("updated_at"), F.count("*").alias("n_blocks"))
    status = F.when(F.col("n_blocks") % 7 == 0, "superseded").otherwise("active")
    size = (F.col("n_blocks") % 5).cast("bigint")
    metadata = F.to_json(F.struct(status.alias("status"), size.alias("size_class"), F.array(status, F.lit("note")).alias("tags")))
    return notes.select(F.col("note_id").alias("document_id"), F.lit("obsidian").alias("source"), "collection", F.col("note_id").alias("external_id"), F.col("note_id").alias("title"), metadata.alias("metadata"), "updated_at")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = table(spark, sf_dir, "note_blocks").select(F.col("block_id").alias("chunk_id"), F.col("note_id").alias("document_id"), F.col("block_index").alias("chunk_index"), F.col("block_text").alias("content"), F.col("unit_tokens").alias("token_count"))
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding")
    return blocks.join(vectors, "chunk_id", "left")


_STORES: dict[tuple, tuple[DataFrame, DataFrame]] = {}


def stored(spark: SparkSession, sf_dir: str, config: str = "simple") -> tuple[DataFrame, DataFrame]:
    """Documents and chunks as an ingested store holds them, chunks with their lexemes: written once a session, and anew
    when a table's files have changed."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    stamps = []
    for name in ("note_blocks", "embeddings"):
        place = path(f"{sf_dir}/{name}.parquet")
        stamps.append(place.getFileSystem(hadoop).getFileStatus(place).getModificationTime())
    key = (spark.sparkContext.applicationId, sf_dir, config, *stamps)
    if key not in _STORES:
        store = Store(spark, f"{shared_folder(spark)}/store-{uuid.uuid4().hex[:12]}")
        store.put_searchable(documents(spark, sf_dir), chunks(spark, sf_dir), config=config)
        _STORES[key] = store.read("documents"), store.read("chunks")
    return _STORES[key]


def query_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    """One stored vector, as a query's."""
    return table(spark, sf_dir, "embeddings").filter("vec_id = 3").select("embedding").first()[0]


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event stream read as retrieval events."""
    k = F.get_json_object("props", "$.k").cast("bigint")
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("note-"), "user_id").alias("note_external_id"), F.col("user_id").alias("session_id"), F.floor(F.col("event_id") / 4).alias("retrieval_index"), F.when(F.col("event_type").isin("view", "click"), "tool").otherwise("start").alias("channel"),
        F.when(F.col("event_type") != "error", F.col("event_id") % 4 + 1).alias("rank"), F.lit("materials").alias("source"), (F.lit(1000) + k * 9).cast("string").alias("external_id"), F.when(F.col("event_type") != "signup", F.col("value") / 500).alias("similarity"),
        (F.col("event_type") == "purchase").alias("used"), F.col("ts").alias("retrieved_at"), F.concat(F.lit("c"), F.col("user_id") % 7).alias("collection"), F.concat(F.lit('{"collection":"c'), k % 7, F.lit('"}')).alias("filters"),
    )


_EVENTS = """
  ev AS (SELECT 'note-' || user_id AS note_external_id, user_id AS session_id, event_id // 4 AS retrieval_index, CASE WHEN event_type IN ('view', 'click') THEN 'tool' ELSE 'start' END AS channel,
    CASE WHEN event_type <> 'error' THEN event_id % 4 + 1 END AS rank, 'materials' AS source, CAST(1000 + CAST(json_extract(props, '$.k') AS BIGINT) * 9 AS VARCHAR) AS external_id,
    CASE WHEN event_type <> 'signup' THEN value / 500 END AS similarity, event_type = 'purchase' AS used, ts AS retrieved_at, 'c' || (user_id % 7) AS collection, 'c' || (CAST(json_extract(props, '$.k') AS BIGINT) % 7) AS asked FROM events),
  sd AS (SELECT doc_id AS document_id, source, CAST(doc_id AS VARCHAR) AS external_id, collection_key AS collection, title FROM documents)"""


def event_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), "source", F.col("doc_id").cast("string").alias("external_id"), F.col("collection_key").alias("collection"), "title")


_COSINE = "list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(qv AS DOUBLE[]))"
_WORDS = r"regexp_extract_all(lower(content), '[\p{L}\p{N}_]+')"


def _search(**options) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        vector = query_vector(spark, sf_dir) if options.get("vector") else None
        named = {k: v for k, v in options.items() if k != "vector"}
        found = search(*stored(spark, sf_dir), query_embedding=vector, match_count=MATCH, config="simple", rank_mode="overlap", linked=True, **named)
        return found.select("chunk_id", "document_id", F.round("fused_score", 9).alias("fused_score"), F.round("vector_similarity", 6).alias("vector_similarity"))

    return run


def _search_sql(*, vector: bool = False, text: list[str] | None = None, where: str = "true", floor: float | None = None, per_document: int | None = 3) -> str:
    """The search spelled out for DuckDB."""
    arms, ctes = [], ""
    if vector:
        ctes += f""",
  vec AS (SELECT chunk_id, document_id, row_number() OVER (ORDER BY sim DESC, chunk_id) AS rank FROM (SELECT *, {_COSINE} AS sim FROM chunks JOIN docs USING (document_id), q WHERE embedding IS NOT NULL AND {where}) {f'WHERE sim >= {floor}' if floor is not None else ''} ORDER BY sim DESC, chunk_id LIMIT 100)"""
        arms.append("SELECT * FROM vec")
    if text:
        need = max(2, -(-len(text) // 2)) if len(text) > 1 else None
        lit = "[" + ", ".join(f"'{w}'" for w in text) + "]"
        keyword = f"coalesce({_COSINE} >= {floor} - 0.08, false)" if vector and floor is not None else "true"
        partial = f" OR (len(list_intersect(words, {lit})) >= {need} AND {keyword})" if need else ""
        ctes += f""",
  txt AS (SELECT chunk_id, document_id, row_number() OVER (ORDER BY strict DESC, density DESC, chunk_id) AS rank FROM (
    SELECT *, list_has_all(words, {lit}) AS strict, len(list_filter(words, lambda w: list_contains({lit}, w))) AS density FROM (SELECT *, {_WORDS} AS words FROM chunks JOIN docs USING (document_id), q WHERE content IS NOT NULL AND {where})
    WHERE list_has_all(words, {lit}){partial}) ORDER BY strict DESC, density DESC, chunk_id LIMIT 100)"""
        arms.append("SELECT * FROM txt")
    cap = f"WHERE pd <= {per_document}" if per_document else ""
    similarity = f"round({_COSINE}, 6)" if vector else "CAST(NULL AS DOUBLE)"
    return f"""WITH {_DOCS}{ctes},
  fused AS (SELECT chunk_id, min(document_id) AS document_id, sum(1.0 / (60 + rank)) AS score FROM ({' UNION ALL '.join(arms)}) GROUP BY chunk_id),
  best AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY score DESC, chunk_id) AS pd FROM fused)
SELECT b.chunk_id, b.document_id, round(score, 9) AS fused_score, {similarity} AS vector_similarity
FROM (SELECT * FROM best {cap} ORDER BY score DESC, chunk_id LIMIT {MATCH}) b JOIN chunks c USING (chunk_id), q"""


def hybrid_search_english(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hybrid search with stemmed words and cover density over stored lexemes: a phrase or a word, without another."""
    found = search(*stored(spark, sf_dir, "english"), query_embedding=query_vector(spark, sf_dir), query_text='"query planner" or parsers -tomatoes', match_count=MATCH, min_similarity=FLOOR, linked=True)
    return found.select("chunk_id", "document_id", F.round("fused_score", 9).alias("fused_score"), F.round("vector_similarity", 6).alias("vector_similarity"))


def document_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents with the key of the first one."""
    docs = table(spark, sf_dir, "documents")
    key = docs.orderBy("doc_id").select("source", "external_id").first()
    return get_document(docs, source=key[0], external_id=key[1]).select("doc_id", "title")


def vector_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "chunk_id")
    return nearest(vectors, query_vector(spark, sf_dir), k=100).select("chunk_id", F.round("similarity", 6).alias("similarity"))


def vector_knn_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every vector whose id is divisible by 20 the ten nearest others of all vectors."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest_of_all(vectors.filter("vec_id % 20 = 0"), vectors, k=MATCH).select("query_id", "vec_id", F.round("similarity", 6).alias("similarity"), "place")


def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two rankings of all documents, fused."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("doc_id").alias("document_id"), F.lit(None).cast("double").alias("similarity"), "created_at", F.length("text").alias("size"))
    newest = docs.orderBy(F.desc("created_at"), "chunk_id").limit(100)
    longest = docs.filter("size IS NOT NULL").orderBy(F.desc("size"), "chunk_id").limit(100)
    from pyspark.sql import Window

    rank = lambda df, c: df.select("chunk_id", "document_id", "similarity", F.row_number().over(Window.orderBy(F.desc(c), "chunk_id")).alias("rank"))
    return fuse([rank(newest, "created_at"), rank(longest, "size")]).select("chunk_id", F.round("fused_score", 9).alias("score"))


def label_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every vector whose id is divisible by 20 the three nearest others of its label with cosine of at least
    a threshold: the threshold join is blocked by label."""
    from pyspark.sql import Window

    vectors = table(spark, sf_dir, "embeddings")
    left = vectors.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "label", F.col("embedding").alias("query"))
    pairs = left.join(vectors, "label").filter("query_id != vec_id").select("query_id", "vec_id", F.round(cosine(F.col("query"), F.col("embedding")), 6).alias("similarity")).filter("similarity >= 0.2")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "vec_id"))
    return pairs.withColumn("place", place).filter("place <= 3")


def filter_metadata_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).filter(contains(F.col("metadata"), {"size_class": 2, "tags": ["note"]})).select("document_id", "collection")


def text_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all blocks and how many blocks hold each."""
    words = chunks(spark, sf_dir).filter("content IS NOT NULL").select("chunk_id", F.explode(F.array_distinct(lexemes(F.col("content"), "simple"))).alias("lexeme"))
    return words.groupBy("lexeme").agg(F.count("*").alias("n_chunks"))


def _cases(spark: SparkSession, sf_dir: str, which: str = "doc_id % 10 = 0") -> tuple[DataFrame, DataFrame]:
    """Golden cases from documents (the title of each of a collection's documents is asked for) and hits: the
    documents of the same collection by age. `which` documents make cases: a tenth, or `true` for all."""
    from pyspark.sql import Window

    docs = table(spark, sf_dir, "documents").filter("title IS NOT NULL AND collection_key IS NOT NULL")
    cases = docs.filter(which).select(F.col("doc_id").alias("case_id"), F.when(F.col("doc_id") % 3 == 0, F.col("source")).alias("realm"), F.col("collection_key").alias("collection"), F.array("external_id").alias("expect"), F.array(F.concat(F.lit("no such text "), "doc_id")).alias("expect_contains"), (F.col("doc_id") % 70 == 0).alias("negative"))
    ranked = docs.select("collection_key", "external_id", "title", F.row_number().over(Window.partitionBy("collection_key").orderBy(F.desc("created_at"), "doc_id")).alias("rank")).filter("rank <= 10")
    hits = cases.select("case_id", "collection").join(ranked, F.col("collection") == F.col("collection_key")).select("case_id", "rank", "external_id", "title", F.lit("").alias("content"))
    return cases, hits


_CASES = """
  docs AS (SELECT * FROM documents WHERE title IS NOT NULL AND collection_key IS NOT NULL),
  cases AS (SELECT doc_id AS case_id, CASE WHEN doc_id % 3 = 0 THEN source END AS realm, collection_key AS collection, external_id AS expect, doc_id % 70 = 0 AS negative FROM docs WHERE doc_id % 10 = 0),
  ranked AS (SELECT * FROM (SELECT collection_key, external_id, row_number() OVER (PARTITION BY collection_key ORDER BY created_at DESC, doc_id) AS rank FROM docs) WHERE rank <= 10),
  found AS (SELECT c.case_id, c.realm, c.collection, c.negative, min(CASE WHEN r.external_id = c.expect THEN r.rank END) AS first_rank, count(r.rank) AS n_hits
    FROM cases c LEFT JOIN ranked r ON r.collection_key = c.collection GROUP BY 1, 2, 3, 4)"""


def _report(function: Callable[..., DataFrame], *names: str, **options) -> Callable[[SparkSession, str], DataFrame]:
    makers = {"events": events, "documents": event_documents}

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return function(*[makers[n](spark, sf_dir) for n in names], **options)

    return run


def audit_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.token_counts(chunks(spark, sf_dir))


def audit_indexes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.chunk_indexes(chunks(spark, sf_dir))


def audit_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.norms(chunks(spark, sf_dir))


def audit_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Missing, repeated and strange chunk indexes of every note; a tenth of the notes counts as loaded without chunks."""
    notes = documents(spark, sf_dir).select("document_id").unionByName(documents(spark, sf_dir).select(F.concat("document_id", F.lit("/empty")).alias("document_id")))
    return audit.chunk_index_faults(chunks(spark, sf_dir), notes)


def audit_vault(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as notes against rows of which some are gone, changed, or of notes that are gone."""
    notes = table(spark, sf_dir, "documents").select("doc_id", F.col("doc_id").cast("string").alias("external_id"), F.sha2(F.coalesce("title", F.lit("")), 256).alias("content_hash"))
    kept = notes.filter("doc_id % 11 != 0").select("external_id", F.when(F.col("doc_id") % 7 == 0, "old").otherwise(F.col("content_hash")).alias("content_hash"), F.lit(None).cast("timestamp").alias("updated_at"))
    gone = notes.filter("doc_id % 13 = 0").select(F.concat(F.lit("gone-"), "external_id").alias("external_id"), "content_hash", F.lit(None).cast("timestamp").alias("updated_at"))
    return audit.vault(notes, kept.unionByName(gone))


def audit_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored vectors against what an embedder makes that has changed for every ninth chunk."""
    held = table(spark, sf_dir, "embeddings").select(F.concat(F.lit("v"), "label").alias("document_id"), F.col("vec_id").alias("chunk_id"), "embedding")
    made = held.select("chunk_id", F.when(F.col("chunk_id") % 9 == 0, F.reverse("embedding")).otherwise(F.col("embedding")).alias("vector"))
    return audit.drift(held, made)


def audit_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five checks together, in the order of the report."""
    found = audit.run_audit(audit_indexes(spark, sf_dir), audit_norms(spark, sf_dir), audit_tokens(spark, sf_dir), audit_vault(spark, sf_dir), audit_drift(spark, sf_dir))
    return found.select("check_name", "check_order", "document_id", "detail")


def parsed_retrievals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event rows parsed back from notes' lists of result tokens made of the events."""
    rows = events(spark, sf_dir)
    token = F.concat("source", F.lit(":"), "external_id", F.coalesce(F.concat(F.lit("@"), F.format_number("similarity", 4)), F.lit("")))
    searches = rows.groupBy("note_external_id", "session_id", "retrieval_index").agg(F.min("retrieved_at").cast("string").alias("at"), F.array_sort(F.collect_list(F.when(F.col("rank").isNotNull(), F.struct("rank", token.alias("token"))))).alias("found"))
    entry = F.struct("at", F.lit("search").alias("tool"), F.lit("").alias("query"), F.transform("found", lambda x: x["token"]).alias("results"))
    notes = searches.groupBy("note_external_id", F.col("session_id").cast("string").alias("session_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("retrieval_index", entry.alias("entry")))), lambda x: x["entry"]).alias("retrievals"))
    return reports.parse_retrievals(notes).select("note_external_id", "retrieval_index", "rank", "source", "external_id", F.round("similarity", 4).alias("similarity"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "hybrid_search": _search(vector=True, query_text=QUERY_TEXT, min_similarity=FLOOR),
    "search_vector_only": _search(vector=True, min_similarity=FLOOR),
    "search_text_only": _search(query_text=QUERY_TEXT),
    "search_no_floor": _search(vector=True, query_text="parser cache", min_similarity=None, max_per_document=None),
    "search_filtered": _search(vector=True, query_text=QUERY_TEXT, min_similarity=0.0, filter_collection="ploverweb", filter_metadata={"size_class": 1}, include_superseded=False),
    "search_per_document_cap": _search(vector=True, query_text="the", min_similarity=None, max_per_document=1),
    "vector_knn": vector_knn,
    "vector_knn_all": vector_knn_all,
    "rrf_fusion": rrf_fusion,
    "label_nearest": label_nearest,
    "filter_metadata_contains": filter_metadata_contains,
    "exclude_superseded": lambda s, d: documents(s, d).filter(not_superseded(F.col("metadata"))).select("document_id"),
    "text_tokens": text_tokens,
    "collection_counts": lambda s, d: list_collections(table(s, d, "documents").withColumnRenamed("collection_key", "collection")),
    "document_lookup": lambda s, d: document_lookup(s, d),
    "report_totals": _report(reports.totals, "events"),
    "report_most_retrieved": _report(reports.most_retrieved, "events"),
    "report_never_retrieved": _report(reports.never_retrieved_counts, "events", "documents"),
    "report_empty_queries": _report(reports.empty_queries, "events"),
    "report_similarity_histogram": _report(reports.similarity_histogram, "events"),
    "report_similarity_summary": _report(reports.similarity_summary, "events"),
    "report_per_collection": _report(reports.per_collection, "events", channels=["tool", "start"]),
    "report_cross_collection": _report(reports.cross_collection, "events"),
    "retrieval_counts": _report(reports.retrieval_counts, "events"),
    "report_with_documents": lambda s, d: reports.with_documents(events(s, d), event_documents(s, d)).groupBy("hit_collection").agg(F.count("*").alias("n_rows"), F.count("hit_title").alias("n_titled")),
    "resolve_results": lambda s, d: reports.resolve_results(events(s, d), event_documents(s, d)).groupBy("result_document_id").agg(F.count("*").alias("n_rows")),
    "parse_retrievals": parsed_retrievals,
    "eval_hit_mrr": lambda s, d: evaluate.scores(evaluate.first_hits(*_cases(s, d))),
    "eval_by_collection": lambda s, d: evaluate.by_collection(evaluate.first_hits(*_cases(s, d))),
    "eval_hit_mrr_all": lambda s, d: evaluate.scores(evaluate.first_hits(*_cases(s, d, "true"))),
    "eval_by_collection_all": lambda s, d: evaluate.by_collection(evaluate.first_hits(*_cases(s, d, "true"))),
    "audit_chunk_index": audit_indexes,
    "audit_norms": audit_norms,
    "audit_token_counts": audit_tokens,
    "audit_all": audit_all,
    "audit_vault": audit_vault,
    "audit_drift": audit_drift,
    "audit_chunk_faults": audit_faults,
    "hybrid_search_english": hybrid_search_english,
}

_INDEX = """SELECT 'chunk index' AS check_name, document_id, 'n=' || n || ' duplicate=' || (n - dn) || ' low=' || low || ' high=' || high AS detail
FROM (SELECT document_id, count(*) AS n, count(DISTINCT chunk_index) AS dn, min(chunk_index) AS low, max(chunk_index) AS high FROM chunks GROUP BY 1) WHERE n <> dn OR low <> 0 OR high <> n - 1"""
_NORM = """SELECT 'norm' AS check_name, document_id, chunk_id || ' none' AS detail FROM chunks WHERE embedding IS NULL"""
_COUNTED = r"coalesce(list_sum(list_transform(regexp_extract_all(content, '[\p{L}\p{N}_]+'), lambda w: CAST(ceil(length(w) / 6.0) AS BIGINT))), 0) + length(regexp_replace(content, '[\p{L}\p{N}_\s\x{0B}\x{1C}-\x{1F}\x{85}\p{Z}]', '', 'g'))"
_TOKENS = f"SELECT 'tokens' AS check_name, document_id, concat_ws(' ', chunk_id, token_count, counted) AS detail FROM (SELECT *, {_COUNTED} AS counted FROM chunks) WHERE counted > 512 OR abs(token_count - counted) > 0.1 * greatest(counted, 1)"
_VAULT = """SELECT * FROM (
  SELECT 'vault' AS check_name, CAST(doc_id AS VARCHAR) AS document_id, CASE WHEN doc_id % 11 = 0 THEN 'missing' WHEN doc_id % 7 = 0 THEN 'differs' END AS detail FROM documents
  UNION ALL SELECT 'vault', 'gone-' || doc_id, 'orphan' FROM documents WHERE doc_id % 13 = 0) WHERE detail IS NOT NULL"""
_DRIFT = """SELECT 'drift' AS check_name, 'v' || label AS document_id, vec_id || ' ' || CAST(value AS DECIMAL(9, 6)) AS detail FROM (
  SELECT *, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(list_reverse(embedding) AS DOUBLE[])), 6) AS value FROM embeddings WHERE vec_id % 9 = 0) WHERE value < 0.999"""
_FAULTS = """
  held AS (SELECT document_id, chunk_index, count(*) AS times FROM chunks GROUP BY 1, 2), sz AS (SELECT document_id, count(*) AS n FROM chunks GROUP BY 1),
  gone AS (SELECT w.document_id, w.i FROM (SELECT document_id, unnest(range(0, n)) AS i FROM sz) w ANTI JOIN held h ON h.document_id = w.document_id AND h.chunk_index = w.i),
  runs AS (SELECT document_id, i, i - row_number() OVER (PARTITION BY document_id ORDER BY i) AS g FROM gone)
SELECT document_id, 'missing' AS fault, min(i) AS chunk_index, max(i) AS until FROM runs GROUP BY document_id, g
UNION ALL SELECT document_id, 'duplicate', chunk_index, chunk_index FROM held WHERE times > 1
UNION ALL SELECT document_id, 'out of range', chunk_index, chunk_index FROM held JOIN sz USING (document_id) WHERE chunk_index IS NULL OR chunk_index < 0 OR chunk_index >= n
UNION ALL SELECT document_id || '/empty', 'childless', NULL, NULL FROM docs"""

ORACLES: dict[str, str] = {
    "hybrid_search": _search_sql(vector=True, text=["the", "query", "planner"], floor=FLOOR),
    "search_vector_only": _search_sql(vector=True, floor=FLOOR),
    "search_text_only": _search_sql(text=["the", "query", "planner"]),
    "search_no_floor": _search_sql(vector=True, text=["parser", "cache"], per_document=None),
    "search_filtered": _search_sql(vector=True, text=["the", "query", "planner"], floor=0.0, where="collection = 'ploverweb' AND size_class = 1 AND coalesce(status, '') <> 'superseded'"),
    "search_per_document_cap": _search_sql(vector=True, text=["the"], per_document=1),
    "vector_knn": "SELECT vec_id AS chunk_id, round(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 6) AS similarity FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 3) q ORDER BY list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) DESC, chunk_id LIMIT 100",
    "vector_knn_all": f"""SELECT query_id, vec_id, round(similarity, 6) AS similarity, place FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS place FROM (
  SELECT a.vec_id AS query_id, b.vec_id, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 9) AS similarity FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0)) WHERE place <= {MATCH}""",
    "rrf_fusion": """WITH a AS (SELECT doc_id AS chunk_id, row_number() OVER (ORDER BY created_at DESC, doc_id) AS rank FROM documents), b AS (SELECT doc_id AS chunk_id, row_number() OVER (ORDER BY length(text) DESC, doc_id) AS rank FROM documents WHERE text IS NOT NULL)
SELECT chunk_id, round(sum(1.0 / (60 + rank)), 9) AS score FROM (SELECT * FROM a WHERE rank <= 100 UNION ALL SELECT * FROM b WHERE rank <= 100) GROUP BY 1""",
    "label_nearest": """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS place FROM (SELECT a.vec_id AS query_id, b.vec_id, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS similarity FROM embeddings a JOIN embeddings b USING (label) WHERE a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id) WHERE similarity >= 0.2) WHERE place <= 3""",
    "filter_metadata_contains": f"WITH {_DOCS} SELECT document_id, collection FROM docs WHERE size_class = 2",
    "exclude_superseded": f"WITH {_DOCS} SELECT document_id FROM docs WHERE status <> 'superseded'",
    "text_tokens": f"SELECT lexeme, count(*) AS n_chunks FROM (SELECT unnest(list_distinct({_WORDS.replace('content', 'block_text')})) AS lexeme FROM note_blocks WHERE block_text IS NOT NULL) GROUP BY 1",
    "collection_counts": "SELECT collection_key AS collection, count(*) AS n_documents FROM documents WHERE collection_key IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 50",
    "document_lookup": "SELECT doc_id, title FROM documents JOIN (SELECT source, external_id FROM documents ORDER BY doc_id LIMIT 1) USING (source, external_id)",
    "report_totals": f"WITH {_EVENTS} SELECT count(*) AS n_rows, count(DISTINCT (note_external_id, session_id, retrieval_index)) AS n_retrievals, count(DISTINCT session_id) AS n_sessions, min(retrieved_at) AS first_at, max(retrieved_at) AS last_at FROM ev",
    "report_most_retrieved": f"WITH {_EVENTS} SELECT source, external_id, count(*) AS n_results, count(DISTINCT session_id) AS n_sessions FROM ev WHERE rank IS NOT NULL GROUP BY 1, 2 ORDER BY 3 DESC, 4 DESC, 1, 2 LIMIT 20",
    "report_never_retrieved": f"WITH {_EVENTS} SELECT coalesce(collection, '(none)') AS collection, count(*) AS n_documents FROM sd WHERE NOT EXISTS (SELECT 1 FROM ev WHERE ev.rank IS NOT NULL AND ev.source = sd.source AND ev.external_id = sd.external_id) GROUP BY 1",
    "report_empty_queries": f"WITH {_EVENTS} SELECT retrieved_at, note_external_id, session_id, retrieval_index FROM ev WHERE rank IS NULL ORDER BY 1 DESC, 2, 3, 4 LIMIT 20",
    "report_similarity_histogram": f"""WITH {_EVENTS}, b AS (SELECT CASE WHEN similarity IS NULL THEN 'n/a' WHEN floor(round(similarity * 20, 9)) < 10 THEN '<0.50' ELSE printf('0.%02d', CAST(least(floor(round(similarity * 20, 9)), 19) * 5 AS INT)) END AS bucket FROM ev WHERE rank IS NOT NULL),
  spine AS (SELECT unnest(['<0.50', '0.50', '0.55', '0.60', '0.65', '0.70', '0.75', '0.80', '0.85', '0.90', '0.95', 'n/a']) AS bucket)
SELECT bucket, count(b.bucket) AS n_results, round(count(b.bucket) / (SELECT count(*) FROM b), 6) AS share FROM spine LEFT JOIN b USING (bucket) GROUP BY 1""",
    "report_similarity_summary": f"WITH {_EVENTS} SELECT round(min(similarity), 6) AS least, round(median(similarity), 6) AS middle, round(max(similarity), 6) AS greatest FROM ev WHERE rank IS NOT NULL",
    "report_per_collection": f"""WITH {_EVENTS}, k AS (SELECT *, (note_external_id, session_id, retrieval_index) AS r FROM ev)
SELECT collection, count(DISTINCT r) AS n_retrievals, count(rank) AS n_results, count(DISTINCT r) FILTER (WHERE rank IS NULL) AS n_empty, count(DISTINCT session_id) AS n_sessions, count(DISTINCT r) FILTER (WHERE channel = 'tool') AS via_tool, count(DISTINCT r) FILTER (WHERE channel = 'start') AS via_start FROM k GROUP BY 1""",
    "report_cross_collection": f"WITH {_EVENTS} SELECT note_external_id, session_id, retrieval_index, min(collection) AS own_collection, min(asked) AS asked_collection FROM ev WHERE asked <> collection GROUP BY 1, 2, 3",
    "retrieval_counts": f"WITH {_EVENTS} SELECT source, external_id, count(DISTINCT (note_external_id, session_id, retrieval_index)) AS n_retrievals, count(DISTINCT (note_external_id, session_id, retrieval_index)) FILTER (WHERE used) AS n_used FROM ev WHERE rank IS NOT NULL GROUP BY 1, 2",
    "report_with_documents": f"WITH {_EVENTS} SELECT sd.collection AS hit_collection, count(*) AS n_rows, count(sd.title) AS n_titled FROM ev LEFT JOIN sd ON sd.source = ev.source AND sd.external_id = ev.external_id GROUP BY 1",
    "resolve_results": f"WITH {_EVENTS} SELECT sd.document_id AS result_document_id, count(*) AS n_rows FROM ev LEFT JOIN sd ON sd.source = ev.source AND sd.external_id = ev.external_id GROUP BY 1",
    "parse_retrievals": f"""WITH {_EVENTS}, s AS (SELECT DISTINCT note_external_id, session_id, retrieval_index FROM ev), n AS (SELECT *, row_number() OVER (PARTITION BY note_external_id ORDER BY retrieval_index) - 1 AS place FROM s)
SELECT n.note_external_id, n.place AS retrieval_index, CASE WHEN ev.rank IS NOT NULL THEN row_number() OVER (PARTITION BY n.note_external_id, n.place ORDER BY ev.rank) END AS rank, ev.source, ev.external_id, round(CASE WHEN ev.rank IS NOT NULL THEN ev.similarity END, 4) AS similarity
FROM n LEFT JOIN ev ON ev.note_external_id = n.note_external_id AND ev.retrieval_index = n.retrieval_index AND ev.rank IS NOT NULL""",
    "eval_hit_mrr": f"WITH {_CASES} SELECT round(coalesce(avg(CASE WHEN coalesce(first_rank <= 3, false) THEN 1.0 ELSE 0.0 END) FILTER (WHERE NOT negative), 1), 6) AS hit_rate, round(coalesce(avg(coalesce(1.0 / first_rank, 0)) FILTER (WHERE NOT negative), 1), 6) AS mrr, round(coalesce(avg(CASE WHEN n_hits = 0 THEN 1.0 ELSE 0.0 END) FILTER (WHERE negative), 1), 6) AS negative_pass_rate FROM found",
    "eval_by_collection": f"WITH {_CASES} SELECT coalesce(realm, '-') AS realm, collection, count(*) AS n_cases, round(avg(CASE WHEN coalesce(first_rank <= 3, false) THEN 1.0 ELSE 0.0 END), 6) AS hit_rate, round(avg(coalesce(1.0 / first_rank, 0)), 6) AS mrr FROM found WHERE NOT negative GROUP BY 1, 2",
    "audit_chunk_index": f"WITH {_DOCS} {_INDEX}",
    "audit_norms": f"WITH {_DOCS} {_NORM}",
    "audit_all": f"WITH {_DOCS} SELECT check_name, CAST(1 AS BIGINT) AS check_order, document_id, detail FROM ({_INDEX}) UNION ALL SELECT check_name, 2, document_id, detail FROM ({_NORM}) UNION ALL SELECT check_name, 3, document_id, detail FROM ({_TOKENS}) UNION ALL SELECT check_name, 4, document_id, detail FROM ({_VAULT}) UNION ALL SELECT check_name, 5, document_id, detail FROM ({_DRIFT})",
    "audit_vault": _VAULT,
    "audit_drift": _DRIFT,
    "audit_chunk_faults": f"WITH {_DOCS}, " + _FAULTS,
    "audit_token_counts": f"WITH {_DOCS}, c AS (SELECT *, {_COUNTED} AS counted FROM chunks) SELECT 'tokens' AS check_name, document_id, concat_ws(' ', chunk_id, token_count, counted) AS detail FROM c WHERE counted > 512 OR abs(token_count - counted) > 0.1 * greatest(counted, 1)",
}
# The same over cases of every document.
ORACLES |= {f"{name}_all": ORACLES[name].replace(" FROM docs WHERE doc_id % 10 = 0)", " FROM docs)") for name in ("eval_hit_mrr", "eval_by_collection")}
