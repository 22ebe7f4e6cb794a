"""Hybrid search: nearest neighbours and full text, fused by reciprocal ranks.

All filters sit below each arm's limit. An arm keeps its pool of best rows task by task before any ranking, so
windows only ever see a few hundred rows; absent arms aren't in the plan. The query vector is a literal.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnwork.functions.jsonq import contains
from tarnwork.functions.lexical import cover_density, lexemes, lexemes_of, needed_lexemes, parse_websearch
from tarnwork.functions.vector import cosine_to
from tarnwork.runtime import ship_active

KEYWORD_MARGIN = 0.08
RESULT = ["chunk_id", "document_id", "source", "collection", "external_id", "title", "content", "metadata", "fused_score", "vector_similarity"]


def check_arguments(query_embedding: Sequence[float] | None, query_text: str | None, match_count: int, max_per_document: int | None, filter_metadata: Any) -> None:
    """Refuse calls that can't be answered."""
    if query_embedding is None and query_text is None:
        raise ValueError("search needs a query_embedding, a query_text or both")
    if match_count is None or match_count < 1:
        raise ValueError(f"match_count must be at least 1, got {match_count}")
    if max_per_document is not None and max_per_document < 1:
        raise ValueError(f"max_per_document must be at least 1 or None, got {max_per_document}")
    if filter_metadata is not None and not isinstance(filter_metadata, dict):
        raise ValueError("filter_metadata must be an object")


def not_superseded(metadata: Column) -> Column:
    """Whether a document's metadata don't call it superseded."""
    return F.coalesce(F.get_json_object(metadata, "$.status"), F.lit("")) != "superseded"


def eligible_documents(documents: DataFrame, *, filter_source: str | None = None, filter_collection: str | None = None, filter_metadata: dict[str, Any] | None = None, include_superseded: bool = True) -> DataFrame:
    """Documents that pass the filters; None means no filter."""
    out = documents
    if filter_source is not None:
        out = out.filter(F.col("source") == filter_source)
    if filter_collection is not None:
        out = out.filter(F.col("collection") == filter_collection)
    if filter_metadata is not None:
        out = out.filter(contains(F.col("metadata"), filter_metadata))
    return out if include_superseded else out.filter(not_superseded(F.col("metadata")))


def _rank_of(found: Column, wanted: list[str], every: bool, mode: str) -> Column:
    if mode == "overlap":
        return F.size(F.filter(found, lambda x: F.coalesce(x.isin(wanted), F.lit(False)))).cast("double")

    ship_active()

    @F.pandas_udf("double")
    def density(rows: pd.Series) -> pd.Series:
        return rows.map(lambda x: cover_density(list(x), wanted, every))

    return density(found)


def ranked_chunks(documents: DataFrame, chunks: DataFrame, *, query_embedding: Sequence[float] | None = None, query_text: str | None = None, match_count: int = 10, filter_source: str | None = None, filter_collection: str | None = None, rrf_k: int = 60, max_per_document: int | None = 3, min_similarity: float | None = 0.70, filter_metadata: dict[str, Any] | None = None, include_superseded: bool = True, config: str = "english", rank_mode: str = "cover", linked: bool = False) -> DataFrame | None:
    """The ranking of `search`, not yet run: `chunk_id`, `owner`, `fused_score`, `vector_similarity` of at most `match_count`
    chunks; None where the text holds no lexeme and there is no vector."""
    check_arguments(query_embedding, query_text, match_count, max_per_document, filter_metadata)
    pool = max(match_count * 10, 100)
    allowed = eligible_documents(documents, filter_source=filter_source, filter_collection=filter_collection, filter_metadata=filter_metadata, include_superseded=include_superseded).select("document_id")
    similarity = cosine_to(F.col("embedding"), query_embedding) if query_embedding is not None else F.lit(None).cast("double")
    filtered = filter_source is not None or filter_collection is not None or filter_metadata is not None or not include_superseded
    scoped = chunks.join(allowed, "document_id") if filtered or not linked else chunks
    arms: list[DataFrame] = []

    if query_embedding is not None:
        near = scoped.filter("embedding IS NOT NULL").select("chunk_id", "document_id", similarity.alias("similarity"))
        if min_similarity is not None:
            near = near.filter(F.col("similarity") >= min_similarity)
        near = near.orderBy(F.desc("similarity"), "chunk_id").limit(pool)
        arms.append(near.select("chunk_id", "document_id", "similarity", F.row_number().over(Window.orderBy(F.desc("similarity"), "chunk_id")).alias("rank")))

    tree = parse_websearch(query_text, config) if query_text is not None else None
    if tree is not None:
        wanted = list(dict.fromkeys(w for w in lexemes_of(query_text, config) if w is not None))
        need = None if tree.negated() else needed_lexemes(len(wanted))
        tokens = F.col("lexemes") if "lexemes" in chunks.columns else lexemes(F.col("content"), config)
        texts = scoped.filter("content IS NOT NULL")
        # A generated column is computed once; a projected one would be copied into every condition that uses it.
        texts = texts.select("*", F.explode(F.array(tokens)).alias("found")) if config == "simple" else texts.withColumn("found", tokens)
        strict = tree.matches(F.col("found"))
        admitted = strict
        if need is not None:
            partial = tree.loosened().matches(F.col("found")) & (F.size(F.array_intersect("found", F.array(*map(F.lit, wanted)))) >= need)
            if query_embedding is not None and min_similarity is not None:
                partial = partial & F.coalesce(similarity >= min_similarity - KEYWORD_MARGIN, F.lit(False))
            admitted = strict | partial
        order = [F.desc("strict"), F.desc("density"), F.asc("chunk_id")]
        matched = texts.filter(admitted).select("chunk_id", "document_id", similarity.alias("similarity"), strict.alias("strict"), _rank_of(F.col("found"), wanted, need is None and tree.op != "or", rank_mode).alias("density"))
        matched = matched.orderBy(*order).limit(pool)
        arms.append(matched.select("chunk_id", "document_id", "similarity", F.row_number().over(Window.orderBy(*order)).alias("rank")))

    if not arms:
        return None
    fused = fuse(arms, rrf_k)  # each arm is one sorted partition of at most `pool` rows: what follows is one task
    best = fused.withColumn("per_document", F.row_number().over(Window.partitionBy("document_id").orderBy(F.desc("fused_score"), "chunk_id")))
    if max_per_document is not None:
        best = best.filter(F.col("per_document") <= max_per_document)
    return best.orderBy(F.desc("fused_score"), "chunk_id").limit(match_count).select("chunk_id", F.col("document_id").alias("owner"), "fused_score", F.col("similarity").alias("vector_similarity"))


def search(documents: DataFrame, chunks: DataFrame, *, query_embedding: Sequence[float] | None = None, query_text: str | None = None, match_count: int = 10, filter_source: str | None = None, filter_collection: str | None = None, rrf_k: int = 60, max_per_document: int | None = 3, min_similarity: float | None = 0.70, filter_metadata: dict[str, Any] | None = None, include_superseded: bool = True, config: str = "english", rank_mode: str = "cover", linked: bool = False) -> DataFrame:
    """The `match_count` best chunks, columns `RESULT`.

    `documents`: `document_id, source, collection, external_id, title, metadata`; `chunks`: `chunk_id,
    document_id, content, embedding` and, where the caller stores them, `lexemes`. Chunks below
    `min_similarity` leave the vector arm; a text match of only part of the lexemes must come within the
    keyword margin of it, and a chunk without vector fails that. Null texts match nothing. Ties: chunk id.
    `linked` says that every chunk has its document, as in a store; then a search without filters needs no join.

    The ranking runs when the search is called; its result, at most `match_count` rows, is then fetched by id, so that
    texts are read for these only and the ids reach the scans as filters.
    """
    top = ranked_chunks(documents, chunks, query_embedding=query_embedding, query_text=query_text, match_count=match_count, filter_source=filter_source, filter_collection=filter_collection, rrf_k=rrf_k, max_per_document=max_per_document, min_similarity=min_similarity, filter_metadata=filter_metadata, include_superseded=include_superseded, config=config, rank_mode=rank_mode, linked=linked)
    if top is None:
        empty = chunks.limit(0).join(documents, "document_id")
        return empty.select(*[c for c in RESULT[:-2]], F.lit(0.0).alias("fused_score"), F.lit(0.0).alias("vector_similarity"))
    rows = top.collect()  # at most `match_count`
    spark = chunks.sparkSession
    found = spark.createDataFrame([tuple(r) for r in rows], top.schema)
    held = chunks.drop("lexemes", "embedding").filter(F.col("chunk_id").isin([r["chunk_id"] for r in rows]))
    owners = documents.filter(F.col("document_id").isin(list({r["owner"] for r in rows})))
    full = held.join(F.broadcast(found.drop("owner")), "chunk_id").join(owners, "document_id")
    return full.select(*RESULT).orderBy(F.desc("fused_score"), "chunk_id")


def fuse(arms: list[DataFrame], rrf_k: int = 60) -> DataFrame:
    """Sum of reciprocal ranks of every chunk over ranked arms (`chunk_id, document_id, similarity, rank`), each of a
    bounded number of rows."""
    union = arms[0]
    for arm in arms[1:]:
        union = union.unionByName(arm)
    return union.coalesce(1).groupBy("chunk_id").agg(F.first("document_id").alias("document_id"), F.max("similarity").alias("similarity"), F.sum(1.0 / (F.lit(rrf_k) + F.col("rank"))).alias("fused_score"))


def named_filters(*, repo: str | None = None, phase: str | None = None, tags: list[str] | None = None) -> dict[str, Any] | None:
    """A metadata filter of the named fields: trimmed, blanks dropped, tags once each in order; None if empty."""
    clean = lambda x: x.strip() if isinstance(x, str) else ""
    out: dict[str, Any] = {k: clean(v) for k, v in (("repo", repo), ("phase", phase)) if clean(v)}
    if kept := list(dict.fromkeys(clean(t) for t in tags or [] if clean(t))):
        out["tags"] = kept
    return out or None


# Bounds of the search tool's arguments.
LIMITS = {"query": 2000, "limit": 50, "tags": 10}


def search_context(documents: DataFrame, chunks: DataFrame, embedder, *, query: str, limit: int = 10, source: str | None = None, collection: str | None = None, min_similarity: float | None = 0.70, repo: str | None = None, phase: str | None = None, tags: list[str] | None = None, include_superseded: bool = False) -> DataFrame:
    """The search tool: checks its arguments, embeds the query and searches; superseded notes stay out."""
    if not query or not query.strip() or len(query) > LIMITS["query"]:
        raise ValueError("query must have 1 to 2000 characters")
    if not 1 <= limit <= LIMITS["limit"]:
        raise ValueError("limit must be 1 to 50")
    if min_similarity is not None and not 0 <= min_similarity <= 1:
        raise ValueError("min_similarity must lie between 0 and 1")
    if len(tags or []) > LIMITS["tags"]:
        raise ValueError("at most 10 tags")
    (vector,) = embedder.embed([query])
    return search(documents, chunks, query_embedding=vector, query_text=query, match_count=limit, filter_source=source, filter_collection=collection, min_similarity=min_similarity, filter_metadata=named_filters(repo=repo, phase=phase, tags=tags), include_superseded=include_superseded)


def get_document(documents: DataFrame, *, source: str, external_id: str) -> DataFrame:
    """The document of a key; no row when there is none."""
    return documents.filter((F.col("source") == source) & (F.col("external_id") == external_id))


def list_collections(documents: DataFrame, limit: int = 50) -> DataFrame:
    """Collections by number of documents."""
    return documents.filter("collection IS NOT NULL").groupBy("collection").agg(F.count("*").alias("n_documents")).orderBy(F.desc("n_documents"), "collection").limit(limit)
