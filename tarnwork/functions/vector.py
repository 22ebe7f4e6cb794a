"""Vectors as arrays of floats: cosine, norm, nearest neighbours, embedding of texts."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator, Sequence
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnwork.runtime import ship, ship_active


def dot(a: Column, b: Column) -> Column:
    """Inner product in doubles."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    """Euclidean length."""
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 with a vector of length zero, null with a null vector."""
    lengths = norm(a) * norm(b)
    return F.when(lengths == 0, F.lit(0.0)).otherwise(dot(a, b) / lengths)


def literal_vector(values: Sequence[float]) -> Column:
    """A query vector inside the plan."""
    return F.array(*[F.lit(float(v)) for v in values])


def cosine_to(vector: Column, query: Sequence[float]) -> Column:
    """Cosine to one fixed query vector; its length is folded on the driver."""
    length = math.sqrt(sum(float(v) ** 2 for v in query))
    if length == 0:
        return F.when(vector.isNotNull(), F.lit(0.0))
    lengths = norm(vector)
    return F.when(lengths == 0, F.lit(0.0)).otherwise(dot(vector, literal_vector(query)) / (lengths * length))


def nearest(df: DataFrame, query: Sequence[float], *, k: int, vector: str = "embedding", key: str = "chunk_id") -> DataFrame:
    """The `k` rows with the greatest cosine to `query`, exact; ties by key. One scan keeping `k` rows a task."""
    return df.filter(F.col(vector).isNotNull()).withColumn("similarity", cosine_to(F.col(vector), query)).orderBy(F.desc("similarity"), key).limit(k)


def nearest_of_all(queries: DataFrame, rows: DataFrame, *, k: int, blocks: int = 16, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """The `k` other rows with the greatest cosine to each row of `queries`, exact; ties by key. Columns `query_id`,
    the key, `similarity`, `place`.

    Every block of queries meets every block of rows in one task, which multiplies slices of them and keeps `k` rows a
    query; the best of all blocks are then ranked. Vectors have one length; null vectors neither ask nor answer.
    """
    side = lambda df, name: df.filter(F.col(vector).isNotNull()).select(F.pmod(F.xxhash64(key), F.lit(blocks)).alias("block"), F.col(key).cast("bigint").alias(name), F.col(vector).cast("array<double>").alias(f"{name}_vector"))
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    asked = side(queries, "q").withColumn("other", every)
    held = side(rows, "r").withColumnRenamed("block", "other").withColumn("block", every)

    def unit(frame: pd.DataFrame, name: str) -> tuple[np.ndarray, np.ndarray]:
        frame = frame.sort_values(name)
        x = np.stack(frame[f"{name}_vector"].to_numpy())
        length = np.linalg.norm(x, axis=1, keepdims=True)
        return frame[name].to_numpy(), np.divide(x, length, out=np.zeros_like(x), where=length > 0)

    def best(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            (ids, x), (keys, y) = unit(left, "q"), unit(right, "r")
            for at in range(0, len(ids), 256):
                near = np.round(x[at : at + 256] @ y.T, 9)
                near[ids[at : at + 256, None] == keys[None]] = -np.inf
                order = np.argsort(-near, axis=1, kind="stable")[:, :k]
                out.append(pd.DataFrame({"query_id": np.repeat(ids[at : at + 256], order.shape[1]), key: keys[order].ravel(), "similarity": np.take_along_axis(near, order, 1).ravel()}))
        found = pd.concat(out) if out else pd.DataFrame({"query_id": pd.Series(dtype="int64"), key: pd.Series(dtype="int64"), "similarity": pd.Series(dtype="float64")})
        return found[found["similarity"] > -np.inf]

    ship(rows.sparkSession)
    pairs = asked.groupBy("block", "other").cogroup(held.groupBy("block", "other")).applyInPandas(best, f"query_id bigint, {key} bigint, similarity double")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), key))
    return pairs.withColumn("place", place).filter(F.col("place") <= k)


class Embedder(Protocol):
    """What turns texts into vectors."""

    dimensions: int

    def embed(self, texts: list[str]) -> list[list[float]]: ...


class HashingEmbedder:
    """A deterministic embedder without a model: signed hashed words and word pairs, unit length."""

    def __init__(self, dimensions: int = 64) -> None:
        self.dimensions = dimensions

    def embed(self, texts: list[str]) -> list[list[float]]:
        from tarnwork.functions.lexical import lexemes_of

        out = []
        for text in texts:
            if not text or not text.strip():
                raise ValueError("a blank text has no vector")
            vector = np.zeros(self.dimensions)
            words = [w for w in lexemes_of(text) if w]
            for term in [*words, *map(" ".join, zip(words, words[1:]))]:
                h = int.from_bytes(hashlib.blake2b(term.encode(), digest_size=8).digest(), "big")
                vector[h % self.dimensions] += 1 if h >> 63 else -1
            length = float(np.linalg.norm(vector))
            out.append((vector / length if length else np.eye(self.dimensions)[0]).tolist())
        return out


def embed_column(text: Column, embedder: Embedder, batch: int = 32) -> Column:
    """Vectors of a text column, in batches; null and blank texts have none."""
    ship_active()

    @F.pandas_udf("array<float>")
    def run(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in series:
            out: list[list[float] | None] = [None] * len(texts)
            full = [i for i, t in enumerate(texts) if t is not None and t.strip()]
            for at in range(0, len(full), batch):
                part = full[at : at + batch]
                vectors = embedder.embed([texts.iloc[i] for i in part])
                if len(vectors) != len(part) or any(len(v) != embedder.dimensions for v in vectors):
                    raise ValueError("the embedder returned vectors of another number or width")
                for i, v in zip(part, vectors):
                    out[i] = v
            yield pd.Series(out)

    return run(text)
