"""A store of parquet snapshots: readers resolve a manifest once, writers add snapshots and move to a new manifest."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwork.functions.lexical import lexemes
from tarnwork.operators import ingest
from tarnwork.runtime import cut_lineage, read_bytes, remove, write_bytes

KEY = ["source", "external_id"]


class Store:
    """Tables under one folder, on any file system that Spark reaches. One writer at a time.

    One file names the snapshot of every table, so that several tables change together; it is replaced by an atomic
    rename and never seen empty or half written."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._path(self.root).getFileSystem(self._conf)

    @property
    def _pointer(self) -> str:
        return f"{self.root}/CURRENT"

    def _manifest(self) -> dict:
        if not self._fs.exists(self._path(self._pointer)):
            return {"tables": {}, "old": []}
        return json.loads(read_bytes(self.spark, self._pointer))

    def exists(self, table: str) -> bool:
        return table in self._manifest()["tables"]

    def read(self, table: str) -> DataFrame:
        """The current snapshot; a missing table is an error, never an empty one."""
        tables = self._manifest()["tables"]
        if table not in tables:
            raise LookupError(f"no table {table} in {self.root}")
        return self.spark.read.parquet(tables[table])

    def replace(self, table: str, df: DataFrame, *, keep: int = 1) -> None:
        """`replace_all` of one table."""
        self.replace_all({table: df}, keep=keep)

    def replace_all(self, tables: dict[str, DataFrame], *, keep: int = 1) -> None:
        """Write new snapshots of all `tables`, then move to them at once. Snapshots that were current before the last
        `keep` moves are deleted; readers that are still at work on the others can go on."""
        held = self._manifest()
        targets = {name: f"{self.root}/{name}/{uuid.uuid4().hex}" for name in tables}
        for name, df in tables.items():
            df.write.parquet(targets[name])
        left = [[held["tables"][n] for n in tables if n in held["tables"]], *held["old"]]
        self._move({"tables": held["tables"] | targets, "old": left[:keep]})
        for path in (p for move in left[keep:] for p in move):
            remove(self.spark, path)

    def _move(self, manifest: dict) -> None:
        jvm, gateway = self.spark.sparkContext._jvm, self.spark.sparkContext._gateway
        fresh = f"{self.root}/{uuid.uuid4().hex}.manifest"
        write_bytes(self.spark, fresh, json.dumps(manifest).encode())
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path(self.root).toUri(), self._conf)
        rename = jvm.org.apache.hadoop.fs.Options.Rename
        options = gateway.new_array(rename, 1)
        options[0] = rename.OVERWRITE
        context.rename(self._path(fresh), self._path(self._pointer), options)

    def append(self, table: str, df: DataFrame) -> None:
        """Add rows; readers of the old snapshot don't see them."""
        self.replace(table, self.read(table).unionByName(df) if self.exists(table) else df)

    def upsert_documents(self, incoming: DataFrame, *, columns: list[str], at: Column, chunks: DataFrame | None = None, config: str = "english", dry_run: bool = False, forced: bool = False) -> DataFrame:
        """Insert or update documents by `(source, external_id)` and return every document's action. A dry run
        only plans. Rows planned as `failed` leave the stored ones as they are.

        With `chunks` (the key, `chunk_index`, `content`, `token_count`, `embedding`) `n_chunks` is counted from them,
        a document without any fails, and the chunks of inserted and updated documents replace those stored, with their
        lexemes, in the same move; a change of metadata alone leaves chunks as they are."""
        if chunks is not None:
            counted = chunks.groupBy(*KEY).agg(F.count("*").alias("n_chunks"))
            incoming = incoming.drop("n_chunks").join(counted, KEY, "left").withColumn("n_chunks", F.coalesce("n_chunks", F.lit(0)))
        empty = incoming.select(*KEY, *columns, at.alias("updated_at")).limit(0)
        stored = self.read("documents") if self.exists("documents") else empty
        planned = ingest.plan_actions(incoming, stored, dry_run=dry_run, forced=forced).withColumn("at", at)
        if dry_run:
            return planned
        planned = cut_lineage(planned, "planned")  # read before the store changes below it
        tables = {"documents": ingest.merge_documents(stored, planned, columns)}
        if chunks is not None:
            written = planned.filter("action IN ('inserted', 'updated')").select(*KEY)
            fresh = with_lexemes(chunks.select(*KEY, "chunk_index", "content", "token_count", "embedding").join(written, KEY, "left_semi"), config)
            tables["chunks"] = self.read("chunks").join(written, KEY, "left_anti").unionByName(fresh) if self.exists("chunks") else fresh
        self.replace_all(tables)
        return planned

    def put_searchable(self, documents: DataFrame, chunks: DataFrame, *, config: str = "english") -> None:
        """Replace documents and chunks as a whole, ready for search: chunks with their lexemes, in order of their id, so
        that the few that a search returns are fetched by the files' ranges."""
        self.replace_all({"documents": documents, "chunks": with_lexemes(chunks, config).repartitionByRange("chunk_id").sortWithinPartitions("chunk_id")})

    def delete_documents(self, keys: DataFrame) -> None:
        """Delete the documents of `keys` and their chunks in one move."""
        gone = keys.select(*KEY).distinct()
        self.replace_all({t: self.read(t).join(gone, KEY, "left_anti") for t in ("documents", "chunks") if self.exists(t)})

    def insert_if_absent(self, table: str, rows: DataFrame, key: list[str]) -> DataFrame:
        """Append the rows whose key isn't stored yet, and return them."""
        fresh = ingest.insert_if_absent(self.read(table), rows, key) if self.exists(table) else rows.dropDuplicates(key)
        landed = cut_lineage(fresh, "landed")  # read before the store changes below it
        self.append(table, landed)
        return landed

    def update_metadata(self, keys: DataFrame, columns: list[str], *, at: Column) -> int:
        """Set `columns` of stored documents from `keys` without touching chunks; returns how many were set. A key that
        isn't stored is an error and nothing is written."""
        stored = self.read("documents")
        new = cut_lineage(keys.select(*KEY, F.lit(True).alias("is_new"), *[F.col(c).alias(f"new_{c}") for c in columns]), "metadata")
        missing = new.join(stored, KEY, "left_anti").count()
        if missing:
            raise LookupError(f"{missing} documents to update aren't stored")
        joined = stored.join(new, KEY, "left")
        pick = lambda c, value: F.when(F.col("is_new"), value).otherwise(F.col(c)).alias(c)
        self.replace("documents", joined.select(*[pick(c, F.col(f"new_{c}")) if c in columns else pick(c, at) if c == "updated_at" else F.col(c) for c in stored.columns]))
        return new.count()

    def replace_by_key(self, table: str, rows: DataFrame, key: list[str]) -> None:
        """Replace all rows of the keys that `rows` has."""
        self.replace(table, ingest.replace_by_key(self.read(table), rows, key) if self.exists(table) else rows)


def with_lexemes(chunks: DataFrame, config: str = "english") -> DataFrame:
    """Chunks with the stored column that text search reads: their lexemes by position, null for null texts."""
    return chunks.withColumn("lexemes", lexemes(F.col("content"), config))
