"""Query variants, and exact top-k vector search as a join of a table of queries with a table of points.

Unit vectors are cut into cells around pivots. A query first meets its own cell, which gives a score that its k-th neighbour reaches;
it then goes to those other cells that could still hold better, by the triangle inequality of angles: no point of a cell is nearer
to the query than the pivot's angle less the cell's radius. Both sides are shuffled by cell, in blocks of bounded size; nothing but the
pivots, a sample of bounded size, reaches the driver, and any choice of pivots gives the same result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULTS, Settings
from ..functions import text as T
from .dedupe import fold_case_dedupe
from .shared import kept

#: Pivots; points and queries of a block; how far a bound may be off by rounding.
PIVOTS, BLOCK_POINTS, BLOCK_QUERIES, SLACK = 64, 1 << 14, 1 << 15, 1e-6


def variants(query: Column, settings: Settings = DEFAULTS, alternatives: Column | None = None, fixed: Column | None = None, translated: Column | None = None) -> Column:
    """Forms of a query to search with, in order, each once: raw, normal, script-specific forms, then what a rewriter offers."""
    q = T.clean(query)

    def forms(x: Column, arabic: Column) -> Column:
        return F.when(arabic, F.array(T.normalize_arabic(x), T.loose_arabic(x))).otherwise(F.array(F.lower(x), T.loose_latin(x)))

    none = F.array().cast("array<string>")
    parts = [F.array(q, T.normalize(q)), forms(q, (T.detect_language(q) == "ar") | T.is_mixed(q))]
    if alternatives is not None:
        parts.append(F.coalesce(alternatives, none))
    if fixed is not None:
        parts.append(F.coalesce(F.when(fixed != "", F.concat(F.array(fixed, T.normalize(fixed)), forms(fixed, T.detect_language(fixed) == "ar"))), none))
    if translated is not None:
        parts.append(F.coalesce(F.when(translated != "", F.concat(F.array(translated), forms(translated, T.detect_language(q) == "en"))), none))
    kept = F.filter(F.array_distinct(F.transform(F.concat(*parts), T.clean)), lambda x: x != "")
    return F.when(q == "", none).otherwise(F.slice(kept, 1, settings.variant_cap))


def anchored(planned: Column, raw: Column) -> Column:
    """Variants of the planner's question with the user's own words appended, each once whatever its case; no words, no change."""
    own = F.array(T.clean(raw), T.normalize(raw), F.when(T.detect_language(raw) == "ar", T.normalize_arabic(raw)).otherwise(F.lower(T.clean(raw))))
    return fold_case_dedupe(F.filter(F.concat(planned, own), lambda x: x != ""))


def fallback_query(query: Column) -> Column:
    """Up to eight plain words of the normal form, searched when nothing was hit."""
    return F.array_join(F.slice(F.regexp_extract_all(T.normalize(query), F.lit(r"([\x{0600}-\x{06FF}a-zA-Z]{2,})"), F.lit(1)), 1, 8), " ")


CELL = ["scope", "dim", "cell"]


def pivots(points: DataFrame, most: int = PIVOTS) -> dict[int, np.ndarray]:
    """Up to ``most`` different unit vectors, by their length, drawn by the hash of the id."""
    drawn = points.where("vector is not null").orderBy(F.xxhash64("point_id"), "point_id").limit(most).select("vector").toArrow()
    by_dim: dict[int, list[np.ndarray]] = {}
    for v in drawn.column("vector").to_pylist():
        if None not in v and np.isfinite(v).all():
            by_dim.setdefault(len(v), []).append(np.array(v, float))
    return {dim: np.unique(_units(np.array(vs).reshape(len(vs), dim), 0), axis=0) for dim, vs in by_dim.items()}


def _units(vectors: np.ndarray, side: int) -> np.ndarray:
    """Unit vectors with two more components: a zero vector becomes an axis of its own, one for points and one for queries, so that
    its cosine with any other is 0 and its length 1."""
    length = np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))
    out = np.zeros((len(vectors), vectors.shape[1] + 2))
    out[:, :-2] = vectors / np.where(length > 0, length, 1)
    out[length[:, 0] == 0, vectors.shape[1] + side] = 1
    return out


def _placed(around: dict[int, np.ndarray], side: int):
    """Vectors as they are given, with the cell of the nearest pivot and their angles: to that pivot (points) or to all (queries).

    Tasks that compare them make unit vectors of them again, as these take more than twice the bytes of single floats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = lambda m: pa.ListArray.from_arrays(pa.array(np.arange(0, m.size + 1, m.shape[1], dtype=np.int32)), pa.array(m.ravel()))
        for batch in batches:
            vectors = batch.column("vector")
            sizes = pc.list_value_length(vectors).to_numpy(zero_copy_only=False)
            for dim in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == dim)
                found = vectors.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(at), dim)  # null as NaN
                fine = np.isfinite(found).all(axis=1)
                at, found = at[fine], found[fine]
                if not len(at):
                    continue
                units = _units(found, side)
                angles = np.arccos(np.clip(units @ around[dim].T, -1, 1)) if dim in around else np.zeros((len(at), 1))
                cell = angles.argmin(axis=1)
                some = batch.take(pa.array(at))
                angle = lists(angles) if side else pa.array(angles[np.arange(len(at)), cell])
                columns = [some.column("id"), some.column("scope"), some.column("vector"), pa.array(np.full(len(at), dim, np.int32)), pa.array(cell.astype(np.int32)), angle]
                yield pa.RecordBatch.from_arrays(columns, ["id", "scope", "v", "dim", "cell", "angle"])

    return run


def _best(k: int, digits: int, at_once: int = 256):
    """The k best points of a block for each query of a block."""

    def run(points: pa.Table, asked: pa.Table) -> pa.Table:
        names, found = ["query_id", "point_id", "score"], []
        if points.num_rows and asked.num_rows:
            dim = points.column("dim")[0].as_py()
            matrix = lambda t, side: _units(t.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float).reshape(t.num_rows, dim), side)
            points = points.sort_by("id")
            p, q, ids = matrix(points, 0), matrix(asked, 1), points.column("id").combine_chunks()
            for a in range(0, len(q), at_once):
                score = np.round(q[a : a + at_once] @ p.T, digits) + 0.0  # no negative zero
                edge = np.partition(score, len(p) - k, axis=1)[:, len(p) - k] if len(p) > k else np.full(len(score), -np.inf)
                which, at = np.nonzero(score >= edge[:, None])
                value = score[which, at]
                order = np.lexsort((at, -value, which))
                which, at, value = which[order], at[order], value[order]
                first = np.searchsorted(which, np.arange(len(score)))
                best = np.arange(len(which)) - first[which] < k
                found.append(pa.table([asked.column("id").take(pa.array(which[best] + a)), ids.take(pa.array(at[best])), pa.array(value[best])], names))
        return pa.concat_tables(found) if found else pa.table([pa.nulls(0, asked.schema.field("id").type), pa.nulls(0, points.schema.field("id").type), pa.nulls(0, pa.float64())], names)

    return run


def _met(asked: DataFrame, points: DataFrame, cells: DataFrame, k: int, digits: int) -> DataFrame:
    """Hits of queries (id, v and a cell) among the points of that cell; blocks of both sides keep hot cells apart."""
    sizes = cells.select(*CELL, F.ceil(F.col("n") / BLOCK_POINTS).alias("p_blocks"))
    sizes = sizes.join(asked.groupBy(*CELL).agg(F.ceil(F.count("*") / BLOCK_QUERIES).alias("q_blocks")), CELL)
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    deal = lambda n: F.pmod(F.xxhash64("id"), F.col(n))
    left = points.join(sizes, CELL).withColumn("b", deal("p_blocks")).withColumn("c", every("q_blocks")).select("id", "v", *CELL, "b", "c")
    right = asked.join(sizes, CELL).withColumn("c", deal("q_blocks")).withColumn("b", every("p_blocks")).select("id", "v", *CELL, "b", "c")
    kinds = f"query_id {dict(asked.dtypes)['id']}, point_id {dict(points.dtypes)['id']}, score double"
    return left.groupBy(*CELL, "b", "c").cogroup(right.groupBy(*CELL, "b", "c")).applyInArrow(_best(k, digits), kinds)


def top_k(queries: DataFrame, points: DataFrame, k: int, scope: str | None = None, digits: int = 6) -> DataFrame:
    """``query_id, point_id, score, rank``: the k points of greatest cosine per query; scores equal to ``digits`` places are ties,
    which the smaller id wins.

    queries: query_id, vector[, scope]; points: point_id, vector[, scope]. With a scope the filter is part of the search: a query only
    meets points of its own. Vectors that are null or hold null or non-finite components take no part, vectors of different lengths
    never meet, and a zero vector scores 0. Rows that share a query id are searched one by one. Queries of one vector are searched once, and of equal points the k smallest ids are
    candidates, so copies cost no more than that.
    """
    shape = lambda df, key: df.select(F.col(key).alias("id"), (F.col(scope) if scope else F.lit(0)).alias("scope"), "vector").where("vector is not null and scope is not null")
    around = pivots(points)
    kind = lambda df: f"id {dict(df.dtypes)['id']}, scope {dict(df.dtypes)['scope']}, v {dict(df.dtypes)['vector']}, dim int, cell int, angle"
    p, q = shape(points, "point_id"), shape(queries, "query_id")
    first = F.row_number().over(Window.partitionBy("scope", "v").orderBy("id"))
    placed = kept(p.mapInArrow(_placed(around, 0), kind(p) + " double").withColumn("_c", first).where(F.col("_c") <= k).drop("_c"))
    cells = kept(placed.groupBy(*CELL).agg(F.count("*").alias("n"), F.min("angle").alias("inner"), F.max("angle").alias("outer")))
    every = kept(q.mapInArrow(_placed(around, 1), kind(q) + " array<double>").withColumn("row", F.monotonically_increasing_id()))
    every = kept(every.withColumn("leader", F.min("row").over(Window.partitionBy("scope", "v"))))
    asked = every.where("row = leader").select(F.col("row").alias("id"), "scope", "v", *CELL[1:], "angle")

    near = kept(_met(asked.drop("angle"), placed, cells, k, digits))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "point_id"))
    sure = near.withColumn("rank", rank).where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("sure"))
    others = asked.withColumnRenamed("cell", "own").select("id", "scope", "v", "dim", "own", F.posexplode("angle").alias("cell", "angle")).where("cell <> own")
    others = others.join(cells, CELL).join(sure, "id", "left")
    least = F.greatest(F.col("angle") - F.col("outer"), F.col("inner") - F.col("angle"), F.lit(0.0))
    others = others.where(F.col("sure").isNull() | (F.cos(least) >= F.col("sure") - SLACK)).select("id", "v", *CELL)
    far = _met(others, placed, cells, k, digits)
    best = near.unionByName(far).withColumn("rank", rank).where(F.col("rank") <= k)
    members = every.select(F.col("id").alias("member"), F.col("leader").alias("query_id"))
    return members.join(best, "query_id").select(F.col("member").alias("query_id"), "point_id", "score", "rank")
