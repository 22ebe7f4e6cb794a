"""Token ids of a public byte-level BPE for a whole corpus.

Ordinary texts are encoded in place, in one Arrow map without a shuffle. Texts longer than `leaf_chars` are
encoded by tree concatenation: they are halved again and again, the halves spread over all tasks and encoded
in parallel, and neighbours joined level by level. Around each join a window is encoded anew, from a sure
boundary of the pattern on the left to one on the right, and grows until the tokens beside the inner
boundaries equal those of both sides; what lies beyond can't differ, since the pattern restarts at a sure
boundary whatever came before.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwork.runtime import arrow_map, cut_lineage

DEFAULT_RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
LEAF_CHARS = 8192

# Fixed value: the public pattern that splits text before the merges of the rank file.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Between two characters of different classes the pattern always splits, except behind white space (a space
#: joins what follows) and behind an apostrophe (which may open a contraction).
_SURE = regex.compile(r"(?<=\p{L})(?!\p{L})|(?<=\p{N})(?!\p{N})|(?<=[^\s\p{L}\p{N}'])(?=[\s\p{L}\p{N}])")


class Codec:
    """Encoder of one rank file; strings that look like special tokens are ordinary text."""

    def __init__(self, ranks_path: str) -> None:
        import tiktoken

        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}
        self.encoding = tiktoken.Encoding("corpus", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.sizes = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, rank in ranks.items():
            self.sizes[rank] = len(token)

    def encode(self, text: str | None) -> list[int]:
        return self.encoding.encode_ordinary(text) if text else []

    def join(self, left: tuple[str, np.ndarray], right: tuple[str, np.ndarray], window: int = 64) -> tuple[str, np.ndarray]:
        """Text and ids of two neighbours as one, exactly as if encoded whole."""
        (a, ids_a), (b, ids_b) = left, right
        if not a or not b:
            return a + b, np.r_[ids_a, ids_b]
        while True:
            span = min(window, max(len(a), len(b)))
            cuts = [m.start() + max(0, len(a) - span) for m in _SURE.finditer(a[-span:]) if 0 < m.start() < len(a[-span:])]
            more = [m.start() for m in _SURE.finditer(b[:span]) if 0 < m.start() < len(b[:span])]
            outer = [0] + cuts if span >= len(a) else cuts
            limit = more + [len(b)] if span >= len(b) else more
            if len(outer) >= 2 and len(limit) >= 2:
                a0, a1, b1, b2 = outer[-2], outer[-1], limit[0], limit[1]
                new = np.asarray(self.encode(a[a0:] + b[:b2]), np.int32)
                keep_a, keep_b = self._count(ids_a, a, a0), self._count(ids_b, b, b2)
                lead = ids_a[keep_a : self._count(ids_a, a, a1)]
                tail = ids_b[self._count(ids_b, b, b1) : keep_b]
                if len(new) >= len(lead) + len(tail) and np.array_equal(new[: len(lead)], lead) and np.array_equal(new[len(new) - len(tail) :], tail):
                    return a + b, np.r_[ids_a[:keep_a], new, ids_b[keep_b:]]
            if span >= len(a) and span >= len(b):
                return a + b, np.asarray(self.encode(a + b), np.int32)
            window *= 2

    def _count(self, ids: np.ndarray, text: str, at: int) -> int:
        """Number of tokens before character `at`, which is a token boundary."""
        if at * 2 <= len(text):
            return int(np.searchsorted(np.cumsum(self.sizes[ids[: 4 * at + 1]]), len(text[:at].encode()), "right")) if at else 0
        back = len(text[at:].encode())
        tail = np.cumsum(self.sizes[ids[::-1][: back + 1]])
        return len(ids) - (int(np.searchsorted(tail, back, "right")) if back else 0)

    def encode_long(self, text: str, leaf_chars: int = LEAF_CHARS) -> np.ndarray:
        """Ids of one text by tree concatenation in this process."""
        return self.merge([(x, np.asarray(self.encode(x), np.int32)) for x in halves(text, leaf_chars)])

    def merge(self, parts: list[tuple[str, np.ndarray]]) -> np.ndarray:
        """Ids of consecutive parts, joined pairwise level by level."""
        while len(parts) > 1:
            parts = [self.join(parts[k], parts[k + 1]) if k + 1 < len(parts) else parts[k] for k in range(0, len(parts), 2)]
        return parts[0][1] if parts else np.zeros(0, np.int32)


def halves(text: str, leaf_chars: int) -> list[str]:
    """`text` halved until no part is longer than `leaf_chars`."""
    parts = [text]
    while any(len(p) > leaf_chars for p in parts):
        parts = [q for p in parts for q in ((p[: len(p) // 2], p[len(p) // 2 :]) if len(p) > leaf_chars else (p,))]
    return parts


@lru_cache(maxsize=4)
def codec(ranks_path: str = DEFAULT_RANKS) -> Codec:
    """The codec of a rank file, loaded once a worker: the copy that came with the job, else the file itself."""
    sent = SparkFiles.get(os.path.basename(ranks_path)) if SparkFiles._root_directory or SparkFiles._is_running_on_worker else ""
    return Codec(sent if os.path.exists(sent) else ranks_path)


def send(df: DataFrame, ranks_path: str) -> None:
    """Let every worker have the rank file that this process can read."""
    if os.path.exists(ranks_path):
        df.sparkSession.sparkContext.addFile(ranks_path)


def _lists(rows: list) -> pa.Array:
    offsets = np.zeros(len(rows) + 1, np.int32)
    np.cumsum([len(r) for r in rows], out=offsets[1:])
    flat = np.concatenate([np.asarray(r, np.int32) for r in rows]) if rows else np.zeros(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32()))


def encode_corpus(df: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", ranks_path: str = DEFAULT_RANKS, leaf_chars: int = LEAF_CHARS) -> DataFrame:
    """`doc_id` and `ids` (array<int>) of every row, without special tokens.

    Null and empty texts give an empty list; repeated rows give repeated results; other columns don't matter.
    A document's ids are one value of the result, so joining its parts in one task adds no bound of its own.
    """
    return _coded(df, id_column, text_column, ranks_path, leaf_chars, counts=False)


def token_counts(df: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", ranks_path: str = DEFAULT_RANKS, leaf_chars: int = LEAF_CHARS) -> DataFrame:
    """`doc_id` and `n_tokens` of every row, by the same steps as `encode_corpus`; 0 for null and empty texts."""
    return _coded(df, id_column, text_column, ranks_path, leaf_chars, counts=True)


def _coded(df: DataFrame, id_column: str, text_column: str, ranks_path: str, leaf_chars: int, *, counts: bool) -> DataFrame:
    send(df, ranks_path)
    rows = df.select(F.col(id_column).cast("bigint").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    result, shape = (pa.field("n_tokens", pa.int64()), "doc_id bigint, n_tokens bigint") if counts else (pa.field("ids", pa.list_(pa.int32())), "doc_id bigint, ids array<int>")
    schema = pa.schema([("doc_id", pa.int64()), result])
    given = lambda ids: pa.array([len(x) for x in ids], pa.int64()) if counts else _lists(ids)

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = codec(ranks_path).encode
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                yield pa.RecordBatch.from_arrays([part.column(0), given([encode(t) for t in part.column(1).to_pylist()])], schema=schema)

    leaf = pa.schema([("row_no", pa.int64()), ("doc_id", pa.int64()), ("place", pa.int32()), ("part", pa.string())])

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                parts = halves(row["text"], leaf_chars)
                n = len(parts)
                yield pa.RecordBatch.from_arrays([pa.array([row["row_no"]] * n, pa.int64()), pa.array([row["doc_id"]] * n, pa.int64()), pa.array(range(n), pa.int32()), pa.array(parts, pa.string())], schema=leaf)

    coded = leaf.append(pa.field("ids", pa.list_(pa.int32())))

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = codec(ranks_path).encode
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, _lists([encode(t) for t in batch.column("part").to_pylist()])], schema=coded)

    def join(group: pa.Table) -> pa.Table:
        parts = sorted(group.select(["place", "part", "ids"]).to_pylist(), key=lambda r: r["place"])
        ids = codec(ranks_path).merge([(r["part"], np.asarray(r["ids"], np.int32)) for r in parts])
        return pa.table([group.column("doc_id").slice(0, 1), given([ids])], schema=schema)

    # Long texts are written once with numbers of their rows, which then hold whatever is computed anew.
    is_long = F.length("text") > leaf_chars
    long = cut_lineage(rows.filter(is_long).withColumn("row_no", F.monotonically_increasing_id()), "long")
    pieces = arrow_map(long.select("row_no", "doc_id", "text"), split, "row_no bigint, doc_id bigint, place int, part string")
    spread = pieces.repartition(F.col("row_no"), F.col("place")).mapInArrow(leaves, "row_no bigint, doc_id bigint, place int, part string, ids array<int>")
    joined = spread.groupBy("row_no").applyInArrow(join, shape)
    return arrow_map(rows.filter(~F.coalesce(is_long, F.lit(False))), short, shape).unionByName(joined)
