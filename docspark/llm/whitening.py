"""Whitening of embeddings by the principal components of their exact integer form.

Components become integers, floor(64 * c) + 1000000. Their sums are exact, and so is the centring n * x - S, which is divided by n only
once it is known; MLlib's ``RowMatrix`` over these rows gives the Gramian, which divided by n is the covariance. It is square in the
length of a vector, never in the number of rows, and goes to the driver for its eigenvectors; the projection, at most 32 vectors of
that length, is broadcast and applied in ``mapInPandas``. The whitened rows are written once; their own covariance, again by
``RowMatrix``, says how far from the identity they are.

Defined cases: vectors that are null, or hold null or non-finite entries, take no part; nor do vectors of another length than most
(the longer of two lengths that tie), empty ones included; a null id is carried along; rows that repeat count each; an empty table
gives no rows; components of no variance have eigenvalues of 0 up to rounding, and their ``whitened`` and, where nothing varies at
all, ``explained`` are null; they are left out of ``identity_error``, which is null if none is left; products 64 * c beyond 2**62 are held there;
a deviation beyond a long is held at its end; only id and vector are read, so other columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise

SCALE, SHIFT, COMPONENTS = 64, 1_000_000, 32
MOST = 2**62
#: Eigenvalues below this share of the largest, times the length of a vector, are rounding.
NOISE = 1e-13


def integers(vectors: Column) -> Column:
    """floor(64 * c) + 1000000 of each entry; null if the vector takes no part."""
    wide = F.transform(vectors, lambda x: x.cast("double"))
    bad = F.exists(wide, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    most = F.lit(float(MOST))
    return F.when(vectors.isNotNull() & ~bad, F.transform(wide, lambda x: F.floor(F.greatest(-most, F.least(most, x * SCALE))).cast("long") + SHIFT))


def gramian(rows: DataFrame, column: str) -> np.ndarray:
    """The sum of outer products of a column of double arrays."""
    vectors = MLUtils.convertVectorColumnsFromML(rows.select(array_to_vector(column).alias("row")), "row")
    return RowMatrix(vectors).computeGramianMatrix().toArray()


def components(covariance: np.ndarray, most: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and their unit vectors as columns."""
    values, vectors = np.linalg.eigh(covariance)
    order = np.argsort(-values, kind="stable")[:most]
    return values[order], vectors[:, order]


def _centred(n: int, sums: list[int]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Exact n * x - S: squared and summed as integers, and divided by n as doubles."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if not len(frame):
                continue
            x = np.stack(frame["x"].to_numpy())
            largest = max(int(x.max(initial=0)), -int(x.min(initial=0))) * n + max(map(abs, sums), default=0)
            moved = x * n - np.array(sums, np.int64) if largest < 2**62 else x.astype(object) * n - np.array(sums, object)
            whole = moved if int(np.abs(moved).max(initial=0)) ** 2 * len(sums) < 2**63 else moved.astype(object)
            deviation = np.minimum((whole * whole).sum(axis=1), 2**63 - 1).astype(np.int64)
            yield pd.DataFrame({"id": frame["id"], "deviation": deviation, "centred": list((moved / n).astype(float))})

    return run


def _projected(sent) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        projection = sent.value
        for frame in frames:
            if len(frame):
                yield pd.DataFrame({"id": frame["id"], "deviation": frame["deviation"], "whitened": list(np.stack(frame["centred"].to_numpy()) @ projection)})

    return run


def whiten(rows: DataFrame, most: int = COMPONENTS, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error`` of each usable row and each of the first ``most`` components."""
    spark = rows.sparkSession
    usable = rows.select(F.col(id_col).cast("string").alias("id"), integers(F.col(vector)).alias("x")).where("x is not null")
    lengths = usable.groupBy(F.size("x").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    dim, n = (lengths["dim"], lengths["count"]) if lengths else (0, 0)
    usable = usable.where(F.size("x") == dim) if dim else usable.where("false")
    whole = usable.agg(*[F.sum(F.get("x", F.lit(i)).cast("decimal(38,0)")).alias(f"s{i}") for i in range(dim)]).first() if dim else []
    usable = usable.withColumn("x", F.col("x").cast("array<long>"))
    centred = materialise(usable.mapInPandas(_centred(n, [int(s) for s in whole]), "id string, deviation long, centred array<double>"))

    covariance = gramian(centred, "centred") / n if dim else np.empty((0, 0))
    values, vectors = components(covariance, most)
    trace = float(np.trace(covariance))
    real = values > NOISE * dim * max(values.max(initial=0), 0.0)
    projection = vectors[:, real] / np.sqrt(values[real])
    sent = spark.sparkContext.broadcast(projection)  # the length of a vector times at most ``most`` doubles
    whitened = materialise(centred.mapInPandas(_projected(sent), "id string, deviation long, whitened array<double>"))

    error, k = None, int(real.sum())
    if k:
        means = list(whitened.agg(*[F.avg(F.get("whitened", F.lit(i))) for i in range(k)]).first())
        middle = F.zip_with("whitened", F.array(*map(F.lit, means)), lambda a, b: a - b)
        error = float(np.abs(gramian(whitened.select(middle.alias("moved")), "moved") / n - np.eye(k)).max())
    shares = [float(v / trace) if trace > 0 else None for v in values]
    parts = F.array(*[F.struct(F.lit(i + 1).alias("component"), F.get("whitened", F.lit(i)).alias("whitened"), F.lit(s).cast("double").alias("explained")) for i, s in enumerate(shares)])
    if not shares:
        parts = F.array().cast("array<struct<component:int,whitened:double,explained:double>>")
    each = whitened.select(F.col("id").cast("long").alias("vec_id"), "deviation", F.explode(parts).alias("part"))
    return each.select("vec_id", "part.component", F.lit(n).cast("long").alias("n"), "deviation", "part.whitened", "part.explained", F.lit(error).cast("double").alias("identity_error"))
