"""Numbers for rows in an order, without one task that sees them all, or all of a key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import kept

RANGES = 200


def numbered(rows: DataFrame, order: str, name: str, *ties: str, ranges: int = RANGES) -> DataFrame:
    """Adds ``name``, the place of each row from 0 by the number ``order``, then ``ties``; nulls come first.

    The table is cut at quantiles of ``order``, each range is numbered by itself, and the ranges' sizes, a few hundred counts that
    reach the driver, say where each begins. Rows that share one value are one range.
    """
    bounds = rows.agg(F.percentile_approx(order, [i / ranges for i in range(1, ranges)], 10_000)).first()[0] or []
    bounds = sorted(set(bounds))
    low, part = F.array(*[F.lit(b) for b in bounds]), F.lit(0)
    if bounds:
        part = F.when(F.col(order).isNull(), 0).otherwise(1 + F.size(F.filter(low, lambda b: b <= F.col(order))))
    dealt = rows.withColumn("_range", part)
    sizes = dict(dealt.groupBy("_range").count().collect())  # as many as there are ranges
    before, total = {}, 0
    for r in sorted(sizes):
        before[r], total = total, total + sizes[r]
    table = F.create_map(*[F.lit(x) for pair in before.items() for x in pair]) if before else F.create_map(F.lit(0), F.lit(0))
    within = F.row_number().over(Window.partitionBy("_range").orderBy(F.asc_nulls_first(order), *ties)) - 1
    return dealt.withColumn(name, F.element_at(table, F.col("_range")) + within).drop("_range")


def dealt(rows: DataFrame, keys: list[str], order: list[str], parts: int | None = None) -> DataFrame:
    """Rows in ranges of (keys, order) of about equal size, with ``_part``, the range; a key with many rows has many."""
    columns = [F.col(c) for c in (*keys, *order)]
    return (rows.repartitionByRange(parts, *columns) if parts else rows.repartitionByRange(*columns)).withColumn("_part", F.spark_partition_id())


def running(rows: DataFrame, keys: list[str], order: list[str], sums: dict[str, Column], totals: dict[str, Column] | None = None, parts: int | None = None) -> DataFrame:
    """Adds running sums over the rows of each key in ``order``, this row included, and sums over all of the key.

    Sums are taken inside ranges of (key, order), then the ranges' sums, one row for each key in a range, say with what a range begins.
    No task holds more of a key than a range. The dealt rows are written, since both steps read them and ranges must be the same.
    """
    totals = totals or {}
    inside = Window.partitionBy(*keys, "_part")
    placed = kept(dealt(rows, keys, order, parts).withColumns({n: F.sum(c).over(inside.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)) for n, c in sums.items()}))
    held = placed.groupBy(*keys, "_part").agg(*[F.sum(c).alias(f"_s_{n}") for n, c in sums.items()], *[F.sum(c).alias(f"_t_{n}") for n, c in totals.items()])
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    begin = held.select(*[F.col(k).alias(f"_k_{i}") for i, k in enumerate(keys)], F.col("_part").alias("_p"), *[F.coalesce(F.sum(f"_s_{n}").over(earlier), F.lit(0)).alias(f"_b_{n}") for n in sums], *[F.sum(f"_t_{n}").over(Window.partitionBy(*keys)).alias(f"_t_{n}") for n in totals])
    same = F.col("_part") == F.col("_p")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{i}"))
    out = placed.join(begin, same).withColumns({n: F.col(n) + F.col(f"_b_{n}") for n in sums} | {n: F.col(f"_t_{n}") for n in totals})
    return out.select(*rows.columns, *sums, *totals)


def numbered_within(rows: DataFrame, keys: list[str], order: list[str], name: str, total: str | None = None, parts: int | None = None) -> DataFrame:
    """Adds ``name``, the place of each row from 1 among its key's in ``order``, and ``total``, how many these are. Rows that tie in ``order`` are numbered as they come."""
    one = F.lit(1)
    return running(rows, keys, order, {name: one}, {total: one} if total else {}, parts)
