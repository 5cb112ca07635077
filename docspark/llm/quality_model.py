"""Quality classifier: logistic regression over hashed word n-grams, learned by follow-the-regularised-leader updates.

An n-gram is a word or a pair of adjacent words, as written and by shape (runs of capitals, small letters and digits made one
sign, other signs kept); a pair of equal words also counts as such. A text's vector holds, per n-gram, its share of the text's
words, so that a score is a sparse dot product divided by the number of words.

The training rows are a bounded sample, ``sample`` rows whose ids have the smallest hash; one task learns from their vectors in the
order of that hash, so the weights do not depend on how rows are dealt. The weights are 2**bits doubles at most, whatever the input.

Defined cases: null and empty texts have only the bias; labels that are null are left out, of several labels of a document one is
taken (the least); without labelled rows all weights are 0 and every score is 0.5; texts of any length are read whole; equal hashes go
by id, and rows that share an id by their vectors; rows are scored independently, so repeated rows repeat and an empty table stays
empty; an input column named like the output is replaced, others are carried along.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WORD_GAP, materialise, slices, texts

BITS = 18
SAMPLE = 12_000
EPOCHS = 5
#: Of the per-coordinate FTRL-proximal update: learning rate, its smoothing, and the two penalties.
ALPHA, BETA, L1, L2 = 3.0, 1.0, 0.005, 0.01
MEMORY = 500_000
GAP = re.compile(WORD_GAP)
_known: dict[str, int] = {}


def shape(word: str) -> str:
    """Capitals as A, other letters as a, digits as 0, each run as one sign; other signs stay."""
    out = []
    for c in word:
        s = ("A" if c.isupper() else "a") if c.isalpha() else "0" if c.isdigit() else c
        if not out or out[-1] != s:
            out.append(s)
    return "".join(out[:12])


def code(word: str) -> int:
    """Hash of a word and of its shape in one number."""
    if len(_known) >= MEMORY:
        _known.clear()
    out = xxhash.xxh32_intdigest(word) << 31 | xxhash.xxh32_intdigest(shape(word)) >> 1
    if len(word) <= 64:
        _known[word] = out
    return out


def features(text: str, bits: int = BITS) -> tuple[np.ndarray, int]:
    """Slots of all n-gram occurrences, and the number of words."""
    words = [w for w in GAP.split(text) if w]
    if not words:
        return np.empty(0, np.int64), 0
    known = _known.get
    codes = np.array([x if (x := known(w)) is not None else code(w) for w in words], np.uint64)
    mask = np.uint64((1 << bits) - 1)
    word, form = codes >> np.uint64(31), codes & np.uint64(0x7FFFFFFF)
    mix, odd = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)

    def slot(x: np.ndarray, kind: int) -> np.ndarray:
        x = (x + np.uint64(kind)) * mix
        return (x ^ x >> np.uint64(29)) * odd >> np.uint64(40) & mask

    same = np.count_nonzero(codes[1:] == codes[:-1])
    parts = [slot(word, 1), slot(form, 2), slot(word[1:] * odd + word[:-1], 3), slot(form[1:] * odd + form[:-1], 4), slot(np.zeros(same, np.uint64), 5)]
    return np.concatenate(parts).astype(np.int64), len(words)


def train(rows: list[tuple[np.ndarray, np.ndarray, int]], bits: int = BITS, epochs: int = EPOCHS) -> np.ndarray:
    """Weights, the bias last. rows: slots, values, label, in the order of learning."""
    size = (1 << bits) + 1
    z, n = np.zeros(size), np.zeros(size)
    for _ in range(epochs):
        for slots, values, label in rows:
            i, x = np.append(slots, size - 1), np.append(values, 1.0)
            zi, ni = z[i], n[i]
            w = np.where(np.abs(zi) <= L1, 0.0, -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(ni)) / ALPHA + L2))
            p = 1 / (1 + np.exp(-np.clip(w @ x, -35, 35)))
            g = (p - label) * x
            z[i] = zi + g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / ALPHA * w
            n[i] = ni + g * g
    return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))


def fit(docs: DataFrame, labels: DataFrame, label: str, usable: Column, bits: int = BITS, sample: int = SAMPLE) -> np.ndarray:
    """Weights learned from at most ``sample`` labelled rows of ``docs`` for which ``usable`` (over doc_id) holds."""
    spark = docs.sparkSession
    chosen = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & usable).groupBy("doc_id").agg(F.min(label).cast("int").alias("y"))
    chosen = chosen.withColumn("h", F.xxhash64("doc_id")).orderBy("h", "doc_id").limit(sample)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # bounded by sample

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            found = [features(x, bits) for x in texts(batch, "text")]
            sparse = [(*np.unique(s, return_counts=True), n) for s, n in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column("h"), batch.column("doc_id"), batch.column("y"), pa.array([s.astype("<i4").tobytes() for s, _, _ in sparse]), pa.array([(k / max(n, 1)).astype("<f4").tobytes() for _, k, n in sparse])],
                ["h", "doc_id", "y", "slots", "shares"],
            )

    def learn(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(frames) or [pd.DataFrame({"h": [], "doc_id": [], "y": [], "slots": [], "shares": []})]).sort_values(["h", "doc_id", "slots"])
        ready = [(np.frombuffer(s, "<i4"), np.frombuffer(v, "<f4").astype(float), y) for s, v, y in zip(frame["slots"], frame["shares"], frame["y"], strict=True)]
        yield pd.DataFrame({"weights": [train(ready, bits).tobytes()]})

    sparse = materialise(rows.mapInArrow(vectors, "h long, doc_id long, y int, slots binary, shares binary"))
    found = sparse.coalesce(1).mapInPandas(learn, "weights binary").collect()
    return np.frombuffer(found[0]["weights"]) if found else np.zeros((1 << bits) + 1)


def score(df: DataFrame, weights: np.ndarray, text: str = "text", out: str = "score") -> DataFrame:
    """Add the probability of label 1 of each whole text; one pass over the rows, no shuffle."""
    sent = df.sparkSession.sparkContext.broadcast(weights)  # 2**bits doubles
    bits = (len(weights) - 1).bit_length() - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = sent.value
        for batch in slices(batches, text):
            names = [c for c in batch.schema.names if c != out]
            found = []
            for x in texts(batch, text):
                slots, n = features(x, bits)
                found.append(1 / (1 + np.exp(-np.clip(w[-1] + w[slots].sum() / max(n, 1), -35, 35))))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(found, pa.float64())], [*names, out])

    return df.mapInArrow(run, T.StructType([*[f for f in df.schema.fields if f.name != out], T.StructField(out, T.DoubleType())]))
