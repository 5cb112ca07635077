"""Splitting texts into chunks: by sentences, recursively, by meaning, and both combined."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULTS, Settings
from ..functions import text as T
from ..functions import vectors as V
from .numbering import numbered_within
from .shared import slices

SEPARATORS = ("\n\n\n", "\n\n", "\n", ".", " ", "")


def sentence_rows(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    return docs.select(key, F.posexplode(T.sentences(F.col(text))).alias("pos", "sentence"))


def sentence_windows(rows: DataFrame, key: str, around: int = DEFAULTS.semantic_buffer) -> DataFrame:
    near = Window.partitionBy(key).orderBy("pos").rowsBetween(-around, around)
    return rows.withColumn("window", F.array_join(F.collect_list("sentence").over(near), " "))


def _pieces(text: str, separators: tuple[str, ...]) -> tuple[list[str], tuple[str, ...]]:
    """Parts at the first separator that occurs, each but the first keeping it in front; and the finer separators left."""
    for i, s in enumerate(separators):
        if s == "":
            return list(text), ()
        if s in text:
            first, *rest = text.split(s)
            return [x for x in (first, *(s + r for r in rest)) if x], separators[i + 1 :]
    return [text], ()


def _joined(parts: list[str], size: int, overlap: int) -> Iterator[str]:
    """Neighbouring parts put together up to ``size``; the next chunk begins with up to ``overlap`` characters of the last one."""
    held: list[str] = []
    total = 0
    for p in parts:
        if held and total + len(p) > size:
            if chunk := "".join(held).strip():
                yield chunk
            while held and (total > overlap or total + len(p) > size):
                total -= len(held.pop(0))
        held.append(p)
        total += len(p)
    if chunk := "".join(held).strip():
        yield chunk


def split_recursively(text: str, size: int, overlap: int, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Chunks of up to ``size`` characters, cut at the coarsest separator that serves."""
    parts, finer = _pieces(text, separators)
    out: list[str] = []
    small: list[str] = []
    for p in parts:
        if len(p) < size:
            small.append(p)
            continue
        out += _joined(small, size, overlap)
        small = []
        if finer:
            out += split_recursively(p, size, overlap, finer)
        else:
            out.append(p)
    return out + list(_joined(small, size, overlap))


def recursive_chunks(docs: DataFrame, key: str, text: str = "text", size: int = DEFAULTS.chunk_size, overlap: int = DEFAULTS.chunk_overlap) -> DataFrame:
    """``key, pos, chunk`` in one pass over the rows."""
    return _per_document(docs, key, {"text": F.col(text)}, lambda row: list(enumerate(split_recursively(row[0] or "", size, overlap))), "pos int, chunk string")


def distances(sentences: list[str], hasher: V.WordHasher, around: int) -> np.ndarray:
    """How far each sentence's window lies from the next one's; a window's counts are those of its sentences."""
    counts = np.array([hasher.counts(x) for x in sentences])
    sums = np.concatenate([np.zeros((1, counts.shape[1])), np.cumsum(counts, axis=0)])
    at = np.arange(len(sentences))
    vectors = V.units(sums[np.minimum(at + around + 1, len(sentences))] - sums[np.maximum(at - around, 0)])
    return 1 - (vectors[:-1] * vectors[1:]).sum(axis=1)


def sentence_groups(sentences: list[str], hasher: V.WordHasher, settings: Settings) -> list[list[str]]:
    """Sentences parted at the distances above the percentile of the document's; both are compared to nine places."""
    if len(sentences) < 2:
        return [sentences] if sentences else []
    far = np.round(distances(sentences, hasher, settings.semantic_buffer), 9)
    cut = np.flatnonzero(far > np.round(np.percentile(far, settings.semantic_percentile), 9)) + 1
    return [sentences[a:b] for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(sentences)], strict=True)]


def _per_document(docs: DataFrame, key: str, columns: dict[str, Column], split: Callable[[tuple], list[tuple]], made: str) -> DataFrame:
    """Rows that ``split`` makes of each document's columns, in the task that reads it; a task holds those of a few documents at a time."""
    kind, names, given = dict(docs.dtypes)[key], [x.split()[0] for x in made.split(", ")], list(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(key)
            types = [pa.int32() if x.split()[1] == "int" else pa.string() for x in made.split(", ")]
            for a, b in slices(batch):
                rows = [(i, *r) for i, x in enumerate(zip(*(batch.column(c).slice(a, b - a).to_pylist() for c in given), strict=True), a) for r in split(x)]
                if rows:
                    at, *out = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(at)), *map(pa.array, out, types)], [key, *names])

    return docs.select(key, *[c.alias(n) for n, c in columns.items()]).mapInArrow(run, f"{key} {kind}, {made}")


def semantic_groups(docs: DataFrame, key: str, text: str = "text", settings: Settings = DEFAULTS) -> DataFrame:
    """``key, grp, n, chunk``: the sentence groups before long ones are split; a text of one sentence stays as it is."""
    hasher = V.WordHasher()

    def split(row: tuple) -> list[tuple]:
        whole, sentences = row[0], list(row[1])
        groups = sentence_groups(sentences, hasher, settings)
        return [(i, len(g), whole if len(sentences) == 1 else " ".join(g)) for i, g in enumerate(groups)]

    return _per_document(docs, key, {"text": F.col(text), "sentences": T.sentences(F.col(text))}, split, "grp int, n int, chunk string")


def semantic_chunks(docs: DataFrame, key: str, text: str = "text", settings: Settings = DEFAULTS) -> DataFrame:
    """``key, pos, chunk``: sentences grouped between the distances above a document's percentile; long groups are split recursively."""
    hasher = V.WordHasher()
    return _per_document(docs, key, {"text": F.col(text), "sentences": T.sentences(F.col(text))}, lambda row: list(enumerate(by_meaning(row[0], list(row[1]), hasher, settings))), "pos int, chunk string")


def by_meaning(whole: str, sentences: list[str], hasher: V.WordHasher, settings: Settings) -> list[str]:
    if len(sentences) < 2:
        return [whole] if sentences else []
    out: list[str] = []
    for g in sentence_groups(sentences, hasher, settings):
        part = " ".join(g)
        out += split_recursively(part, settings.chunk_size, settings.chunk_overlap) if len(part) > settings.semantic_max_chars else [part]
    return out


def merge_similar(texts: list[str], vectors: np.ndarray, similarity: float, most: int) -> list[str]:
    """Neighbours joined while alike and within ``most`` characters; likeness is that of adjacent base chunks."""
    out, held = [], [texts[0]]
    for i in range(1, len(texts)):
        if float(vectors[i - 1] @ vectors[i]) >= similarity and sum(map(len, held)) + 1 + len(texts[i]) <= most:
            held.append(texts[i])
        else:
            out.append(" ".join(held).strip())
            held = [texts[i]]
    return [*out, " ".join(held).strip()]


#: As ``functions.text.is_meaningful``, for chunks that do not leave their task.
BLANK = " \t\n\x0b\f\r"
LETTER = re.compile("[\u0600-\u06ffa-zA-Z]")


def hybrid_chunks(docs: DataFrame, key: str, text: str = "text", settings: Settings = DEFAULTS) -> DataFrame:
    """``key, pos, chunk``: small recursive chunks, embedded once, neighbours of a document merged while alike."""
    hasher = V.WordHasher()
    return _per_document(docs, key, {"text": F.col(text)}, lambda row: list(enumerate(by_both(row[0] or "", hasher, settings))), "pos int, chunk string")


def by_both(whole: str, hasher: V.WordHasher, settings: Settings) -> list[str]:
    base = [c for c in split_recursively(whole, settings.hybrid_base_size, 0) if len(c.strip(BLANK)) >= 15 and LETTER.search(c)]
    return merge_similar(base, hasher.embed(base), settings.hybrid_similarity, settings.hybrid_max_chars) if base else []


def chunk(docs: DataFrame, key: str, text: str = "text", settings: Settings = DEFAULTS) -> DataFrame:
    """Chunks by the configured strategy; a document that it leaves without chunks, or fails on, is split recursively. Meaningless chunks go."""
    strategy = settings.chunking_strategy.lower()
    hasher = V.WordHasher()

    def split(row: tuple) -> list[tuple]:
        whole = row[0] or ""
        try:
            out = by_meaning(whole, list(row[1]), hasher, settings) if strategy == "semantic" else by_both(whole, hasher, settings) if strategy == "hybrid" else []
        except (ValueError, ArithmeticError, IndexError):
            out = []
        return list(enumerate(out or split_recursively(whole, settings.chunk_size, settings.chunk_overlap)))

    made = _per_document(docs, key, {"text": F.col(text), "sentences": T.sentences(F.col(text)) if strategy == "semantic" else F.array().cast("array<string>")}, split, "pos int, chunk string")
    return made.where(T.is_meaningful(F.col("chunk")))


def number_chunks(chunks: DataFrame, source: str, order: list[str]) -> DataFrame:
    """``chunk_index`` from 0 and ``total_chunks`` per source, however many chunks one has."""
    made = numbered_within(chunks, [source], order, "chunk_index", "total_chunks")
    return made.withColumn("chunk_index", (F.col("chunk_index") - 1).cast("int"))
