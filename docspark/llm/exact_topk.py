"""Exact top-k by inner product over a vector-approximation file.

Components become integers floor(scale * x). A vector's approximation is a byte per component, its cell, and the width of its cells, a
power of two; the file of approximations is written once, in packed blocks, beside the exact vectors. For a query the cells bound every
inner product from both sides. A first scan reads approximations alone and keeps, for each query, what may still reach the k-th lower
bound. Exact vectors are then read in the order of the bounds, in two rounds: the k of greatest upper bound, and of the rest those
that can still reach the k-th result found.

Equal vectors have equal scores, so of each only the k + 1 smallest ids are candidates: a vector that a third of all rows share costs
no more than that, and the cut is made before rows are shuffled. Every block of queries meets every block of approximations, which
travel at an eighth of the exact vectors' size; nothing is broadcast, and nothing is dropped but what the bounds exclude.

Defined cases: null ids and null vectors, and vectors holding null or non-finite components, take no part; vectors of another length
than the query's are no candidates for it; ties go to the smaller id; rows that share an id are candidates one by one, but never for
their own id, and as a query the least vector of that id counts; with fewer candidates than k all are returned; components beyond
2**62 are held there, and scores beyond a long at its ends; vectors may be of any length; an empty table gives no rows; only id and
vector are read, so other columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

SCALE = 64
#: Components of a packed block of candidates or queries; blocks that one task scans; the least number of query blocks.
COMPONENTS, BLOCKS_A_TASK, LEAST_TASKS = 1 << 19, 64, 24
CELLS = "c long, dim int, ids binary, rids binary, widths binary, cells binary"
ASKED = "dim int, q int, ids binary, vectors binary"
HITS = "query_id long, rid long, id long, lower double, upper double"
MOST = 2**62


def integers(vectors: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of each component; null if the vector takes no part."""
    wide = F.transform(vectors, lambda x: x.cast("double"))
    bad = F.exists(wide, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    most = F.lit(float(MOST))
    return F.when(vectors.isNotNull() & ~bad, F.transform(wide, lambda x: F.floor(F.greatest(-most, F.least(most, x * scale))).cast("long")))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def approximate(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The cell of each component as a byte, and each vector's shift: a component lies within 2**shift from its cell times that on."""
    top = np.maximum(vectors.max(axis=1, initial=0), -1 - vectors.min(axis=1, initial=0))
    shift = np.zeros(len(vectors), np.int64)
    while (over := top >> shift > 127).any():
        shift += over
    return (vectors >> shift[:, None]).astype(np.int8), shift.astype(np.int8)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Approximations of each batch's vectors, some to a row."""
    base, made = TaskContext.get().partitionId() << 32, 0
    for batch in batches:
        dims = batch.column("dim").to_numpy()
        for dim in np.unique(dims).tolist():
            some = batch.filter(pa.array(dims == dim))
            step = max(1, COMPONENTS // max(dim, 1))
            for a in range(0, some.num_rows, step):
                part = some.slice(a, step)
                cells, shift = approximate(_matrix(part.column("v"), dim) if dim else np.empty((part.num_rows, 0), np.int64))
                row = [base + made, dim, *(part.column(x).to_numpy().astype("<i8").tobytes() for x in ("id", "rid")), shift.tobytes(), cells.tobytes()]
                made += 1
                kinds = (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], [x.split()[0] for x in CELLS.split(", ")])


def _pack_queries(table: pa.Table) -> pa.Table:
    dim, q = table.column("dim")[0].as_py(), table.column("q")[0].as_py()
    vectors = table.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype("<i8").tobytes()
    row = [dim, q, table.column("id").to_numpy().astype("<i8").tobytes(), vectors]
    return pa.table([pa.array([x], k) for x, k in zip(row, (pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)], [x.split()[0] for x in ASKED.split(", ")])


def bounds(queries: np.ndarray, cells: np.ndarray, shift: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the inner products of queries with approximated vectors."""
    width = np.ldexp(1.0, shift.astype(np.int32))
    wide = queries.astype(float)
    middle = wide @ (cells * width[:, None] + (width[:, None] - 1) / 2).T
    size = np.abs(wide).sum(axis=1)[:, None]
    largest = (np.abs(cells.astype(float)).max(axis=1, initial=0) + 1) * width
    slack = size * (width - 1) / 2 + size * largest * 1e-13 * (queries.shape[1] + 8) * (size * largest > 2**51)  # whole numbers below 2**53 are exact
    return np.clip(middle - slack, -(2.0**63), 2.0**63), np.clip(middle + slack, -(2.0**63), 2.0**63)  # as scores are held


def undominated(lower: np.ndarray, upper: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places that fewer than k others surely come before."""
    if len(ids) <= k:
        return np.arange(len(ids))
    edge = np.partition(lower, len(lower) - k)[len(lower) - k]
    above = int(np.count_nonzero(lower > edge))
    last = np.partition(ids[lower == edge], k - above - 1)[k - above - 1]  # the id of the k-th by lower bound
    return np.flatnonzero((upper > edge) | (upper == edge) & (ids <= last))


def _scan(k: int, at_once: int = 128):
    def run(blocks: pa.Table, asked: pa.Table) -> pa.Table:
        found: list[tuple[np.ndarray, ...]] = []
        if blocks.num_rows and asked.num_rows:
            dim = asked.column("dim")[0].as_py()
            own, queries = np.frombuffer(asked.column("ids")[0].as_py(), "<i8"), np.frombuffer(asked.column("vectors")[0].as_py(), "<i8")
            queries = queries.reshape(len(own), dim)
            read = lambda name, kind: [np.frombuffer(x, kind) for x in blocks.column(name).to_pylist()]
            ids, rids, shifts, cells = read("ids", "<i8"), read("rids", "<i8"), read("widths", np.int8), read("cells", np.int8)
            for a in range(0, len(own), at_once):
                kept: list[list[tuple[np.ndarray, ...]]] = [[] for _ in own[a : a + at_once]]
                for some, rows, shift, cell in zip(ids, rids, shifts, cells, strict=True):
                    lower, upper = bounds(queries[a : a + at_once], cell.reshape(len(some), dim), shift)
                    for i, q in enumerate(own[a : a + at_once]):
                        at = np.flatnonzero(some != q)
                        at = at[undominated(lower[i][at], upper[i][at], some[at], k)]
                        kept[i].append((rows[at], some[at], lower[i][at], upper[i][at]))
                for q, parts in zip(own[a : a + at_once], kept, strict=True):
                    rows, some, lower, upper = (np.concatenate(x) for x in zip(*parts, strict=True))
                    at = undominated(lower, upper, some, k)
                    found.append((np.full(len(at), q), rows[at], some[at], lower[at], upper[at]))
        columns = [np.concatenate(x) for x in zip(*found, strict=True)] if found else [np.empty(0, t) for t in (np.int64,) * 3 + (float,) * 2]
        return pa.table([pa.array(x) for x in columns], [x.split()[0] for x in HITS.split(", ")])

    return run


def inner_product(a: np.ndarray, b: np.ndarray) -> int:
    if len(a) and float(np.abs(a.astype(float)).max()) * float(np.abs(b.astype(float)).max()) * len(a) < 2**62:
        return int(a @ b)
    return min(max(sum(x * y for x, y in zip(a.tolist(), b.tolist(), strict=True)), -(2**63)), 2**63 - 1)


def _products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = []
        for c in ("q", "v"):
            flat, ends = batch.column(c).flatten().to_numpy(zero_copy_only=False), np.cumsum(batch.column(c).value_lengths().to_numpy())
            lists.append(np.split(flat, ends[:-1]) if len(ends) else [])
        scores = pa.array([inner_product(a, b) for a, b in zip(*lists, strict=True)], pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column("query_id"), batch.column("rid"), batch.column("id"), scores], ["query_id", "rid", "id", "score"])


def top_k(rows: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the k best rows for each row that ``is_query`` holds for."""
    usable = rows.select(F.col(id_col).cast("long").alias("id"), integers(F.col(vector), scale).alias("v"), is_query.alias("asks")).where("id is not null and v is not null")
    each = usable.groupBy("v", "id").agg(F.count("*").alias("n"))
    first = each.withColumn("place", F.row_number().over(Window.partitionBy("v").orderBy("id"))).where(F.col("place") <= k + 1)
    repeated = first.select("id", "v", F.explode(F.sequence(F.lit(1), F.least("n", F.lit(k)).cast("int"))))
    exact = materialise(repeated.select(F.monotonically_increasing_id().alias("rid"), "id", "v", F.size("v").alias("dim")))
    cells = materialise(exact.mapInArrow(_pack, CELLS))
    queries = materialise(usable.where("asks").groupBy("id").agg(F.min("v").alias("v")).select("id", "v", F.size("v").alias("dim")))

    n, total = cells.agg(F.count("*"), F.lit(0)).first()[0], queries.agg(F.coalesce(F.sum("dim"), F.lit(0))).first()[0]
    q_blocks = max(LEAST_TASKS, -(-total // COMPONENTS))
    shares = max(1, -(-n // BLOCKS_A_TASK))
    every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    asked = queries.withColumn("q", F.pmod(F.xxhash64("id"), F.lit(q_blocks)).cast("int")).groupBy("dim", "q").applyInArrow(_pack_queries, ASKED)
    left = cells.withColumn("share", F.pmod(F.xxhash64("c"), F.lit(shares)).cast("int")).withColumn("q", every(q_blocks)).groupBy("dim", "q", "share")
    hits = left.cogroup(asked.withColumn("share", every(shares)).groupBy("dim", "q", "share")).applyInArrow(_scan(k), HITS)
    hits = materialise(hits)

    per = Window.partitionBy("query_id")
    edge = hits.withColumn("place", F.row_number().over(per.orderBy(F.desc("lower"), "id"))).where(F.col("place") == k).select("query_id", F.col("lower").alias("edge"), F.col("id").alias("last"))
    may = F.col("edge").isNull() | (F.col("upper") > F.col("edge")) | (F.col("upper") == F.col("edge")) & (F.col("id") <= F.col("last"))
    left = hits.join(edge, "query_id", "left").where(may).withColumn("place", F.row_number().over(per.orderBy(F.desc("upper"), "id", "rid"))).select("query_id", "rid", "id", "upper", "place")

    def scored(some: DataFrame) -> DataFrame:
        pairs = some.select("query_id", "rid", "id").join(exact.select("rid", "v"), "rid").join(queries.select(F.col("id").alias("query_id"), F.col("v").alias("q")), "query_id")
        return pairs.select("query_id", "rid", "id", "q", "v").mapInArrow(_products, "query_id long, rid long, id long, score long")

    best = materialise(scored(left.where(F.col("place") <= k)))
    kth = best.groupBy("query_id").agg(F.min("score").alias("kth"))
    rest = scored(left.where(F.col("place") > k).join(kth, "query_id").where(F.col("upper") >= F.col("kth")))
    ranked = best.unionByName(rest).withColumn("rank", F.row_number().over(per.orderBy(F.desc("score"), "id", "rid")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias("vec_id"), "score")
