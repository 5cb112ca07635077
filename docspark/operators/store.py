"""Chunk store, registry and document lifecycle on versioned Parquet tables."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared
from .versions import VersionedTables

REGISTRY = "conversation_id string, file_hash string, filename string, stored_path string, file_type string, chunks int, processed_at timestamp, document_id string"
CHUNKS = "conversation_id string, document_id string, source string, page int, chunk_index int, total_chunks int, text string, embedding array<float>, file_type string, chunk_type string, sheet_name string, row_range string"


def file_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def stored_name(filename: Column, digest: Column) -> Column:
    """``stem_hash10.ext`` of an object."""
    ext = F.regexp_extract(filename, r"(\.[^.]*)$", 1)
    return F.concat(F.substring(filename, F.lit(1), F.length(filename) - F.length(ext)), F.lit("_"), F.substring(digest, 1, 10), ext)


def new_uploads(uploads: DataFrame, registry: DataFrame) -> DataFrame:
    """Uploads whose (conversation_id, file_hash) is not registered. Equal files of one batch all pass, as the registry decides."""
    return uploads.join(registry.select("conversation_id", "file_hash").distinct(), ["conversation_id", "file_hash"], "left_anti")


def unseen_results(results: DataFrame, known: DataFrame, key: str = "chunk_id") -> DataFrame:
    return results.join(known.select(key).distinct(), key, "left_anti")


def without_conversation(rows: DataFrame, conversation_id: str) -> DataFrame:
    return rows.where(~F.col("conversation_id").eqNullSafe(conversation_id))


def without_document(rows: DataFrame, document_id: str, conversation_id: str) -> DataFrame:
    return rows.where(~(F.col("document_id").eqNullSafe(document_id) & F.col("conversation_id").eqNullSafe(conversation_id)))


def by_name(registry: DataFrame, filename: str | None = None, document_id: str | None = None) -> DataFrame:
    """Registry rows of a file name, whatever its case, or of a document."""
    rows = registry if filename is None else registry.where(F.lower("filename") == filename.lower())
    return rows if document_id is None else rows.where(F.col("document_id") == document_id)


def files(registry: DataFrame, conversation_id: str | None = None) -> DataFrame:
    """Registered files, the latest first; of all conversations if none is named."""
    rows = registry if conversation_id is None else registry.where(F.col("conversation_id") == conversation_id)
    return rows.orderBy(F.desc("processed_at"), "filename")


class ChunkStore:
    """Chunks and registry below one folder, in buckets of the conversation, so that reading one conversation prunes the others.

    A change of both tables is one version (``versions``): whoever dies in between leaves the old one, and a batch that runs again is told
    by the ledger.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64, dim: int | None = None):
        self.spark, self.path, self.dim = spark, path.rstrip("/"), dim
        self.tables = VersionedTables(spark, f"{self.path}/tables", {"chunks": CHUNKS, "registry": REGISTRY}, "conversation_id", buckets)
        self._asides: list[str] = []

    def _tidy(self) -> None:
        """Delete what was written aside, once nothing reads it any more."""
        while self._asides:
            shared.delete(self.spark, self._asides.pop())

    def bucket(self, conversation: Column) -> Column:
        return self.tables.bucket(conversation)

    def ready(self, tries: int = 5, wait: float = 2.0) -> bool:
        """Whether the store can be read, asked a few times; a store that nothing was added to is ready. Never raises."""
        for i in range(tries):
            try:
                return self.read("registry").limit(1).count() >= 0
            except Exception:
                if i + 1 < tries:
                    time.sleep(wait)
        return False

    def registered(self, conversation_id: str, filename: str | None = None, document_id: str | None = None) -> DataFrame:
        """A conversation's registry rows, of one file name or document if given, the latest first."""
        return files(by_name(self.tables.of("registry", conversation_id), filename, document_id))

    def read(self, name: str) -> DataFrame:
        return self.tables.read(name)

    def chunks(self, conversation_id: str) -> DataFrame:
        """A conversation's chunks; only its bucket is read, and the equality filter is pushed down."""
        return self.tables.of("chunks", conversation_id)

    def _check(self, chunks: DataFrame) -> None:
        """Vectors must have the store's length."""
        if self.dim is not None and chunks.where(F.size("embedding") != self.dim).limit(1).count():
            raise RuntimeError(f"vectors must have {self.dim} components")

    def add(self, chunks: DataFrame, registry: DataFrame, batch: tuple[str, int] | None = None) -> None:
        """Both tables or neither; a stream's batch goes into the ledger with them."""
        self._check(chunks)
        change = self.tables.change()
        change.append("chunks", chunks)
        change.append("registry", registry)
        change.commit(batch)
        self._tidy()

    def _swap(self, conversation_id: str, keep: Column, chunks: DataFrame | None = None, registry: DataFrame | None = None) -> dict[str, int]:
        """Rewrite a conversation's bucket of both tables without the rows that ``keep`` excludes, plus what is given, as one change;
        how many rows were left out of each."""
        change, number, gone = self.tables.change(), self.tables.number(conversation_id), {}
        for name, extra in (("chunks", chunks), ("registry", registry)):
            old = change.rows(name, [number]).drop("bucket")
            gone[name] = old.where(~keep).count()
            if gone[name] or extra is not None:
                left = old.where(keep)
                change.rewrite(name, [number], left if extra is None else left.unionByName(extra.select(*left.columns)))
        if any(gone.values()) or chunks is not None:
            change.commit()
        self._tidy()
        return gone

    def _held(self, rows: DataFrame) -> DataFrame:
        """Rows written aside, worked out once."""
        aside = f"{self.path}/_aside/{uuid.uuid4().hex}"
        rows.write.parquet(aside)
        self._asides.append(aside)
        return self.spark.read.schema(rows.schema).parquet(aside)

    def delete_conversation(self, conversation_id: str) -> int:
        """Number of registry rows removed; 0 on repetition."""
        return self._swap(conversation_id, ~F.col("conversation_id").eqNullSafe(conversation_id))["registry"]

    def delete_document(self, document_id: str, conversation_id: str) -> int:
        """Number of chunks removed; 0 on repetition, and for another conversation's document."""
        return self._swap(conversation_id, ~(F.col("document_id").eqNullSafe(document_id) & F.col("conversation_id").eqNullSafe(conversation_id)))["chunks"]

    def reindex(self, document_id: str, conversation_id: str, chunks: DataFrame, registry: DataFrame) -> int:
        """Replace a document's chunks and registry row as one change; its id stays. Refuses unknown documents and empty replacements."""
        if not self.registered(conversation_id, document_id=document_id).limit(1).count():
            raise ValueError(f"document {document_id} is not in conversation {conversation_id}")
        chunks = self._held(chunks)  # parsed and embedded once
        n = chunks.count()
        if not n:
            raise ValueError("the new version has no chunks")
        self._check(chunks)
        keep = ~(F.col("document_id").eqNullSafe(document_id) & F.col("conversation_id").eqNullSafe(conversation_id))
        self._swap(conversation_id, keep, chunks, registry)
        return n
