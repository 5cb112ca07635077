"""Vector functions on arrays of numbers, and a deterministic embedder that needs no model."""

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

BUCKETS = 128


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def word_bucket(word: Column) -> Column:
    """md5 of a word modulo 128, which its last byte decides."""
    return F.conv(F.substring(F.md5(word), -2, 2), 16, 10).cast("int") % BUCKETS


class WordHasher:
    """Unit vectors of texts' bags of lower-case words; the first unit vector for a text without words. Keeps the words it has seen."""

    dim = BUCKETS

    def __init__(self, most: int = 1 << 17):
        self.known: dict[str, int] = {}
        self.most = most

    def counts(self, text: str) -> np.ndarray:
        out = np.zeros(BUCKETS)
        for w in text.lower().split():
            if (b := self.known.get(w)) is None:
                if len(self.known) >= self.most:
                    self.known.clear()
                b = self.known[w] = hashlib.md5(w.encode()).digest()[-1] % BUCKETS
            out[b] += 1
        return out

    def embed(self, texts: list[str]) -> np.ndarray:
        return units(np.array([self.counts(x or "") for x in texts]).reshape(-1, BUCKETS))


def units(counts: np.ndarray) -> np.ndarray:
    out = counts.copy()
    length = np.sqrt((out * out).sum(axis=1))
    out[length == 0, 0] = length[length == 0] = 1.0
    return out / length[:, None]


@F.pandas_udf(ArrayType(DoubleType()))
def hash_embedding(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """``WordHasher`` over Arrow batches."""
    hasher = WordHasher()
    for batch in texts:
        yield pd.Series(list(hasher.embed(batch.tolist())), dtype=object)
